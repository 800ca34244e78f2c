import base64
import bz2
import gzip
import hashlib
import lzma
import re
import urllib.parse
import zlib

from text_tables import documents  # noqa: F401
from voxelloom.llm import secrets

KEY = "AKIA" + "Z" * 16


def plain(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_plain_spans():
    cases = ["", "pass", 'PassWord = "abcdef"', "token=abc secret:abcdef", "token:secret=abcdef", "toKen=abcdefg", "api_key=123456 apikey : 1234567",
             KEY, KEY[:-1], "AKIAAKIA" + "B" * 12, "é" * 5 + "a" * 24 + "g" + "0" * 23, "paſſword=abcdefg", "secret = ab cdefgh", "x" * 100_000 + " token=abcdefgh"]
    for text in cases:
        assert secrets.scan(text) == plain(text), text


def test_layers_map_to_the_original():
    inner = "password=hunter2secret"
    b64 = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(gzip.compress(base64.b64encode(gzip.compress(KEY.encode())))).decode()
    cases = {
        f"see {b64} end": (4, 4 + len(b64)),
        f"see {packed} end": (4, 4 + len(packed)),
        "go password%3Dabcdefgh x": (3, 22),
        "go " + urllib.parse.quote(urllib.parse.quote("token=abcdefgh", safe="")) + " x": (3, 3 + len("token%253Dabcdefgh")),
        "go password\\u003dabcdefgh x": (3, 25),
        "é " + "".join(f"\\u{ord(c):04x}" for c in "token=abcdefgh"): (2, 2 + 6 * 14),
    }
    for text, span in cases.items():
        base, spans, layers, long = secrets.find(text)
        assert span in [(a, b) for a, _, b in spans], (text, spans)
        assert set(base) <= set(spans) and layers > 1 and not long


def test_fixpoint_and_odd_input():
    text = "%25" * 50 + "%" + "%2" + "\\u00" + "\\ud83d\\ude00 \\ud83d"
    base, spans, layers, _ = secrets.find(text)
    assert base == [] and spans == [] and layers < 10
    deep = "token=abcdefgh"
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert secrets.find(deep)[1] == [(0, 0, len(deep))]


def test_query(spark, documents):
    rows = [(1, f"a {KEY} b"), (2, None), (None, "token=abcdefgh"), (3, ""), (1, f"a {KEY} b")]
    got = [tuple(r) for r in secrets.digest(secrets.secrets(documents(rows))).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 5 and by[1][1:4] == (0, 1, 0) and by[1][5] == "access:2:22"
    assert by[1][4] == hashlib.sha256(b"access:2:22").hexdigest() and by[2][4] == hashlib.sha256(b"").hexdigest()
    assert by[None][1] == 1
    assert secrets.secrets(documents([]).limit(0)).count() == 0


def test_same_run_at_two_places():
    inner = "x password=hunter2secret y token%3Dabcdefgh"
    for run in (base64.b64encode(inner.encode()).decode(), base64.b64encode(gzip.compress(inner.encode())).decode()):
        text = f"one {run} and two {run} end"
        at = [m.start() for m in re.finditer(re.escape(run), text)]
        assert {(a, k, b) for a, k, b in secrets.find(text)[1] if b - a == len(run)} == {(a, 0, a + len(run)) for a in at}
        assert len(at) == 2


def test_layers_of_any_bytes():
    key = "password=hunter2secret"
    noise = "".join(f"{hashlib.sha256(bytes([i])).hexdigest()[:23]}g, " for i in range(40))
    raws = {"bom": b"\xef\xbb\xbf" + key.encode(), "nbsp": ("\u00a0\u200b\f" + key).encode(), "nul": b"file.txt" + bytes(90) + key.encode() + bytes(400),
            "utf16": key.encode("utf-16"), "utf16be": key.encode("utf-16-be"), "utf32": key.encode("utf-32-be"), "bad": b"\xff\xfe\x80 " + key.encode()}
    texts = {n: base64.b64encode(r).decode() for n, r in raws.items()}
    texts |= {f"packed {n}": base64.b64encode(gzip.compress(r)).decode() for n, r in raws.items()}
    texts["members"] = base64.b64encode(gzip.compress(b"first ") + gzip.compress(key.encode())).decode()
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        texts[f"wrapped {pack.__module__}"] = base64.encodebytes(pack((noise + key).encode())).decode()
        texts[f"joined {pack.__module__}"] = "path/to_some-" + base64.b64encode(pack(key.encode())).decode()
    texts["wrapped plain"] = base64.encodebytes(("," * 50 + key).encode()).decode()
    for n in range(4):
        texts[f"joined {n}"] = "w" * n + "/" + base64.b64encode(("," * 20 + key).encode()).decode()
    for name, text in texts.items():
        spans = secrets.find(f"see {text} end")[1]
        assert any(k == 0 and a >= 4 and b <= 4 + len(text) for a, k, b in spans), (name, spans)


def test_long_runs_are_scanned_to_the_end():
    raw = "é, word; ".encode() * 7_000_000 + b"password=hunter2secret" + b", " * 100
    assert len(raw) > secrets.UNPACKED
    for pack in (bz2.compress, lambda r: zlib.compress(r, 1)):
        text = base64.b64encode(pack(raw)).decode()
        base, spans, _, long = secrets.find(text)
        assert not base and (0, 0, len(text)) in spans and long == 1
