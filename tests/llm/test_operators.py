import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from text_tables import documents  # noqa: F401
from voxelloom.llm import ann, decontam, linededup, lm, mixing, quality, toxicity, urls
from voxelloom.llm.common import Work, words
from voxelloom.llm.eliasfano import EliasFano, Trie, quantise, restore


# line dedup

def similar_lines(rows):
    """Every line with an earlier one of Jaccard 0.8 or more, by comparing all pairs."""
    seen, bad = [], set()
    for doc, text in sorted((d, t or "") for d, t in rows):
        for i, line in enumerate(text.split("\n")):
            s = set(words(line.encode()))
            if not s:
                continue
            if any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                bad.add((doc, i))
            seen.append(s)
    return bad


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_matches_all_pairs(spark, documents, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 40))] for _ in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice([*vocab, f"new{rng.random()}"])
            lines.append(" ".join(line) if rng.random() < 0.9 else " ".join(rng.sample(line, len(line))).upper())
        rows.append((d * 7, "\n".join(lines)))
    bad = similar_lines(rows)
    got = {(r["doc_id"], r["line"]) for r in linededup.removed(documents(rows).select("doc_id", "text"), Work(spark, "t")).collect()}
    assert got == bad and bad


def test_line_dedup_dense_group(spark, documents):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for d in range(150):
        line = list(base)
        for _ in range(rng.randint(0, 7)):
            line[rng.randrange(40)] = f"x{rng.randrange(20)}"
        rows.append((d, "keep me\n" + " ".join(line)))
    got = {(r["doc_id"], r["line"]) for r in linededup.removed(documents(rows).select("doc_id", "text"), Work(spark, "t")).collect()}
    assert got == similar_lines(rows)


def test_line_dedup_cases(spark, documents):
    a = "one two three four five six"
    rows = [(2, a), (1, f"{a}\nshort line\nshort line\n{a.upper()}"), (3, None), (4, ""), (None, a), (2, a), (5, "é ü ö ä ß â\n" + "z " * 50_000)]
    got = sorted(map(tuple, linededup.dedup(documents(rows)).collect()))
    assert [(g[0], g[2], g[3]) for g in got] == [(1, 4, 2), (2, 1, 1), (2, 1, 1), (3, 0, 0), (4, 1, 0), (5, 2, 0)]
    by = {g[0]: g[1] for g in got}
    assert by[1] == f"{a}\nshort line" and by[2] == "" and by[3] is None and by[4] == ""
    assert linededup.dedup(documents([]).limit(0)).count() == 0


def test_prefix_holds_a_common_word():
    for n in range(1, 60):
        for m in range(n, 60):
            need = -(-4 * (n + m) // 9)
            if m * 4 <= n * 5 and need <= n:
                assert linededup.prefix_size(n) + need > n and linededup.prefix_size(m) + need > m


def test_long_lines_meet_only_what_may_be_similar(spark, documents):
    rng = random.Random(8)
    rows = []
    for d in range(40):
        line = [f"d{d // 2}w{i}" for i in range(150 + 4 * (d // 2))] + ["shared"]
        for i in range(d % 2 * 12):
            line[i] = f"x{d}y{i}"
        rng.shuffle(line)
        rows.append((d, " ".join(line)))
    docs = documents(rows).select("doc_id", "text")
    found = linededup.lines(docs, linededup.rarity(docs)).withColumn("at", F.lit(0))
    a, b = found.alias("a"), found.alias("b")
    met = a.join(b, (F.col("b.doc_id") < F.col("a.doc_id")) & linededup._may_match(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")))
    assert sorted(map(tuple, met.select("b.doc_id", "a.doc_id").collect())) == [(d, d + 1) for d in range(0, 40, 2)]
    got = {(r["doc_id"], r["line"]) for r in linededup.removed(docs, Work(spark, "t")).collect()}
    assert got == similar_lines(rows) == {(d, 0) for d in range(1, 40, 2)}


@pytest.mark.parametrize("few", [0, 100])
def test_line_dedup_in_slices_and_mixed_lengths(spark, documents, monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW", few)
    monkeypatch.setattr(linededup, "PASSES", 3)
    rng = random.Random(few)
    base = [[f"v{rng.randrange(900)}" for _ in range(n)] for n in (1, 4, 5, 9, 30, 60, 64, 66, 70, 130, 300, 700)]
    rows = [(7, None), (8, ""), (9, "\n\n \t\n")]
    for d in range(10, 90):
        lines = []
        for _ in range(3):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, max(1, len(line) // 9))):
                if rng.random() < 0.5 or len(line) < 2:
                    line.append(f"n{rng.randrange(3000)}")
                else:
                    line.pop(rng.randrange(len(line)))
            lines.append("\u00c9\u2003a \x0b" + rng.choice([" ", "\t", "  \r"]).join(line).upper() + " \u00e9")
        rows.append((d, "\n".join(lines)))
    docs = documents(rows).select("doc_id", "text").repartition(3)
    got = {(r["doc_id"], r["line"]) for r in linededup.removed(docs, Work(spark, "t")).collect()}
    assert got == similar_lines([(d, t or "") for d, t in rows]) and got


def test_line_dedup_splits_and_hashes_words():
    texts = ["", "a b", "B\n\n a\x0b\u00e9\u2003x\x0c", "\n", " \t", "ab", "q" * 300_000 + " a\n" + "yz " * 100_000, "a"]
    for cut in (texts, texts[1:]):
        array = pa.array([None, *texts]).slice(1 + len(texts) - len(cut))
        h, line, first_line = linededup._coded(array)
        want = [(w, at + i) for at, t in zip(first_line.tolist(), cut) for i, x in enumerate(t.split("\n")) for w in words(x.encode())]
        assert line.tolist() == [n for _, n in want]
        assert len(set(h.tolist())) == len({w for w, _ in want}) == len(set(zip(h.tolist(), (w for w, _ in want))))


@pytest.mark.parametrize("often", [0, 20, 255])
def test_line_dedup_frequent_words_and_dense_groups(spark, documents, monkeypatch, often):
    for name, value in {"OFTEN": often, "DENSE": 8, "NAMED": 1, "BUCKET_WORDS": 500}.items():
        monkeypatch.setattr(linededup, name, value)
    rng = random.Random(often)
    base = [[f"b{rng.randrange(60)}" for _ in range(n)] for n in (1, 2, 5, 30, 40, 90)]
    rows = []
    for d in range(120):
        lines = [list(rng.choice(base)) for _ in range(2)]
        for line in lines:
            for _ in range(rng.randint(0, 1 + len(line) // 6)):
                line[rng.randrange(len(line))] = f"x{rng.randrange(40)}"
        rows.append((d // 2 * 2 if d < 20 else d, "\n".join(map(" ".join, lines))))
    rows += rows[30:40]
    got = {(r["doc_id"], r["line"]) for r in linededup.removed(documents(rows[20:]).select("doc_id", "text"), Work(spark, "t")).collect()}
    assert got == similar_lines(dict(rows[20:]).items()) and got


def test_line_dedup_names_few_candidates_of_a_dense_group(spark, documents):
    def met(size):
        rng, base = random.Random(6), [f"b{i}" for i in range(40)]
        rows = [(d, " ".join([*base[:-4], *(f"x{rng.randrange(60)}" for _ in range(4))])) for d in range(size)]
        docs = documents(rows).select("doc_id", "text")
        found = linededup.lines(docs, linededup.rarity(docs)).withColumn("seek", F.lit(True))
        return linededup._candidates(found, 1, linededup.NAMED).count()
    assert met(1600) < 6 * met(400)


# language model

def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in [(0, 1), (1, 1), (1, 2 ** 40), (1000, 900), (5000, 2 ** 45), (3000, 2 ** 31)]:
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano.encode(v)
        assert (ef.get(np.arange(n)) == v).all()
        x = rng.integers(0, top, 500).astype(np.uint64)
        lo = np.zeros(500, dtype=np.int64)
        assert (ef.next_geq(x, lo, lo + n) == np.searchsorted(v, x)).all()


def test_trie_finds_pairs(tmp_path):
    rng = np.random.default_rng(2)
    keys = np.unique((rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 2 ** 32, 4000).astype(np.uint64))
    codes = rng.integers(1, 60000, len(keys)).astype(np.uint16)
    Trie.write(str(tmp_path / "t"), keys, codes)
    trie = Trie(str(tmp_path / "t"))
    ask = np.concatenate([keys, keys + np.uint64(1), np.array([99 << 32], dtype=np.uint64)])
    lo, hi, base = trie.context(ask >> np.uint64(32))
    want = dict(zip(keys.tolist(), codes.tolist()))
    assert trie.find(ask & np.uint64(0xFFFFFFFF), lo, hi, base).tolist() == [want.get(k, 0) for k in ask.tolist()]
    Trie.write(str(tmp_path / "e"), keys[:0], codes[:0])
    assert not Trie(str(tmp_path / "e")).context(ask)[1].any()
    p = np.array([1.0, 0.5, 1e-9])
    assert np.allclose(np.log10(restore(quantise(p))), np.log10(p), atol=3e-4)


def test_scores_match_brute_force(spark, documents, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("A bb ccc dd e ff été".split()) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(100, None), (101, "unseen words only"), (102, "a\x0bb\tc" * 3000), (102, "again"), (None, "a")]
    docs = [(i, [*words((t or "").encode()), b""]) for i, t in rows if i is not None]
    c, pair, follow = Counter(), Counter(), defaultdict(set)
    for i, w in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
            for a, b in zip([b"", *w], w):
                pair[a, b] += 1
                follow[a].add(b)
    n, v = sum(c.values()), len(c)
    one = lambda w: (c[w] + 1) / (n + 1 * (v + 1))

    def p(a, b):
        if not c[a]:
            return one(b)
        return max(pair[a, b] - 0.75, 0) / c[a] + 0.75 * len(follow[a]) / c[a] * one(b)
    assert abs(sum(p(b"bb", w) for w in c) + p(b"bb", b"never") - 1) < 1e-9
    for size, hot in ((10 ** 6, 1 << 16), (50, 1 << 16), (50, 20)):
        monkeypatch.setattr(lm, "HOT", hot)
        got = sorted(map(tuple, lm.score(documents(rows), chunk_tokens=size).collect()))
        want = sorted((i, zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(one(x)) for x in w),
                       sum(math.log10(p(a, b)) for a, b in zip([b"", *w], w))) for i, w in docs)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
        assert all(abs(g[6] - w[6]) < 3e-4 * w[2] for g, w in zip(got, want))  # half a step of the codes a token
    assert lm.score(documents([]).limit(0)).count() == 0


# nearest vectors

def test_nearest_first_block_bounds_the_others(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((1500, 12))
    ids = np.arange(1500)
    truth = np.sort(np.sqrt(((x[:50, None] - x[None]) ** 2).sum(-1)) + np.where(np.eye(50, 1500), np.inf, 0), axis=1)[:, :10]
    rounds = []
    looked = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: (rounds.append(1), looked(*a, **k))[1])
    q, _, d = ann.search_block(ids, x, ids[:50], x[:50], 10, truth[:, -1])
    assert len(rounds) <= 3 * ann.PROJECTIONS                    # one look, however many queries
    monkeypatch.undo()
    assert sum(np.isin(truth[j], d[q == j]).sum() for j in range(50)) >= 490
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id < 50")).toPandas()
    assert (got.groupby("query_id").size() == 10).all() and got["query_id"].nunique() == 50
    near = {(r.query_id, round(r.score, 9)) for r in got.itertuples()}
    assert sum((j, round(s, 9)) in near for j in range(50) for s in truth[j]) >= 490


def test_nearest_recall_and_cases(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[5] = x[700]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(9000, None, 0), (9100, [0.0] * 32, 0), (9200, [float("nan")] * 32, 0), (9300, [None] * 32, 0), (None, [1.0] * 32, 0), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, block int")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert len(got[q]) == 10 and all(abs(d[i] - s) < 1e-12 for i, s in got[q])
        hit += len({i for i, _ in got[q]} & set(map(int, best)))
    assert hit >= 0.95 * 300 and set(got) == set(range(0, 3000, 100)) and got[700][0] == (5, 0.0)
    few = ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 3
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# decontamination

def test_contamination(spark, documents):
    item = "The train leaves Boston at 9 and travels 120 miles with Anna before it reaches the old harbour town in 3 hours"
    again = item.replace("Boston", "Lyon").replace(" 9 ", " 11 ").replace("120", "85").replace("Anna", "Peter").replace("3 hours", "7 hours")
    clash = "add 5 and 5 to the sum of all books on that shelf near the door"
    bench = spark.createDataFrame([(1, item, "z"), (2, clash, "z"), (3, None, "z"), (4, "short", "z"), (5, "just these seven plain words stand here", "z")],
                                  "item_id bigint, text string, h string")
    pad = "some words before it and "
    rows = [(1, pad + item), (2, pad + again + " more words follow"), (3, clash.replace("5", "6")), (4, clash.replace("5 and 5", "6 and 7")),
            (5, "nothing of the kind is in here, only short words"), (6, None), (7, ""), (8, pad + "just these seven plain words stand here too"),
            (None, item), (9, "x " * 40_000 + item), (1, pad + item)]
    got = {r["doc_id"]: r["item_id"] for r in decontam.contamination(documents(rows), bench).collect()}
    assert {k: v for k, v in got.items() if k != 4} == {1: 1, 2: 1, 3: 2, 8: 5, 9: 1}
    first = decontam.Reader()(clash.replace("5 and 5", "6 and 7"))
    want = decontam.Reader()(clash)
    assert decontam.windows(*first)[1][0] != decontam.windows(*want)[1][0]  # other slots are equal
    kept = {r["doc_id"] for r in decontam.clean(documents(rows), bench).collect()}
    assert {5, 6, 7, None} <= kept and not kept & {1, 2, 3, 8, 9}
    assert decontam.contamination(documents([]).limit(0), bench).count() == 0
    assert decontam.contamination(documents(rows), bench.limit(0)).count() == 0


def test_contamination_of_starts_and_few_literals(spark, documents):
    items = [(1, "Which planet is the largest in our solar system?"), (2, "James has 3 cats. Anna owns 5 dogs. Peter sold 7 birds."),
             (3, "Paris Berlin Rome Madrid Lisbon 1998 2003 Vienna Oslo 2011"), (4, "Where does Tom keep 12 of his best old red books?")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, "Science quiz\nWhich planet is the largest in our solar system?"), (2, "Sums\n" + items[1][1].replace("James", "Mary").replace("Anna", "Tim").replace("7", "9")),
            (3, "they were in paris berlin rome madrid lisbon 1998 2003 vienna oslo 2011 and left"), (4, "Oslo Rome Berlin Paris Vienna 1998 2003 Lisbon Madrid 2011"),
            (5, "he asked where does Ann keep 15 of his best old red books"), (6, "so which planet is the largest in our solar system")]
    got = {r["doc_id"]: r["item_id"] for r in decontam.contamination(documents(rows), bench).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 5: 4, 6: 1}


def test_short_items_match_whole_lines_and_sentences(spark, documents):
    bench = spark.createDataFrame([(1, "Who wrote the Iliad?"), (2, "Stop. Think again. Go!"), (3, "Yes")], "item_id bigint, text string")
    rows = [(1, "Here is one. who wrote the iliad? Nobody knows."), (2, "He asked who wrote the Iliad and left."), (3, "a\nWho wrote the Iliad\nb"),
            (4, "First stop. Think again. Go!\nyes"), (5, "Well. Stop. Think again. Go! Yes"), (6, "- Who wrote the Iliad?"), (7, "who wrote"), (8, "Who wrote the Iliad")]
    got = {r["doc_id"]: r["item_id"] for r in decontam.contamination(documents(rows), bench).collect()}
    assert got == {1: 1, 3: 1, 5: 2, 6: 1, 8: 1}


def matched(docs, items, width=10, literals=6, whole=3):
    """Item, windows and first place of each document by plain tuples in place of hashes, blocks and bits."""
    reader = decontam.Reader()

    def words_of(text):
        kind, value, maybe, unit, _, sentence = (x.tolist() for x in reader.read_all([text or ""]))
        return list(zip(kind, value, maybe, unit)), sentence

    def shape(part, chosen):
        kinds = [decontam.LITERAL if k == decontam.NAME and m and c else k for (k, _, m, _), c in zip(part, chosen)]
        kinds = [decontam.UNIT if k == decontam.LITERAL and u else k for k, (*_, u) in zip(kinds, part)]
        slots = [v for k, (_, v, *_) in zip(kinds, part) if k != decontam.LITERAL]
        return (tuple(v if k == decontam.LITERAL else -k for k, (_, v, *_) in zip(kinds, part)), tuple(slots.index(x) for x in slots)), \
            kinds.count(decontam.LITERAL)

    wanted, widths = {}, set()
    for item, text in items:
        row, _ = words_of(text)
        plain = [shape([w], [False])[1] if not w[3] else 0 for w in row]
        wide = [n for n in range(min(width, len(row)), len(row) + 1) if any(sum(plain[a:a + n]) >= literals for a in range(len(row) - n + 1))]
        for n in {min(width, len(row)), *wide[:1]} - {0}:
            keys = [("whole", tuple(w[1] for w in row))] if whole <= len(row) < literals else []
            for a in range(len(row) - n + 1):
                part = row[a:a + n]
                for bits in range(1 << n):
                    chosen = [bits >> i & 1 for i in range(n)]
                    if all(not c or w[2] for c, w in zip(chosen, part)):
                        key, count = shape(part, chosen)
                        keys += [key] * (count >= literals)
                keys += [("words", tuple(w[1] for w in part))] * (n >= literals)
            for key in keys:
                wanted[key] = min(item, wanted.get(key, item))
                widths.add(n)
    out = {}
    for doc, text in docs:
        row, sentence = words_of(text)
        hits = set()
        for n in widths:
            for a in range(len(row) - n + 1):
                part, keys = row[a:a + n], []
                for as_literal in (False, True):
                    key, count = shape(part, [as_literal] * n)
                    keys += [key] * (count >= literals)
                keys += [("words", tuple(w[1] for w in part))] * (n >= literals)
                edges = (a == 0 or sentence[a] != sentence[a - 1]) and (a + n == len(row) or sentence[a + n] != sentence[a + n - 1])
                keys += [("whole", tuple(w[1] for w in part))] * (n < literals and edges)
                found = [wanted[k] for k in keys if k in wanted]
                hits |= {(min(found), a)} if found else set()
        best = defaultdict(set)
        for item, a in hits:
            best[item].add(a)
        if best:
            item = min(best, key=lambda i: (-len(best[i]), i))
            out[doc] = (item, len(best[item]), min(best[item]))
    return out


def test_contamination_against_brute_force(spark, documents, monkeypatch):
    rng = random.Random(8)
    vocab = ["the", "of", "red", "Anna", "Tom", "Oslo", "5", "7", "12", "km", "kg", "runs.", "sits", "how", "far", "Why", "--", "old?", "to"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" "] * 9 + ["\n"]) for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 5, 7, 9, 11, 14]))) for i in range(30)]
    docs = []
    for d in range(150):
        body = rng.choice(items)[1]
        swaps = dict(zip(["5", "7", "12", "Anna", "Tom"], rng.sample(["8", "9", "7"], 3) + rng.sample(["Eva", "Tom"], 2)))
        if d % 3:
            body = " ".join(swaps.get(w, w) for w in body.split(" "))
        docs.append((d, text(rng.randint(0, 30)) + rng.choice(["\n", " "]) + body + rng.choice(["\n", " "]) + text(rng.randint(0, 30))))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 900)
    got = {r["doc_id"]: (r["item_id"], r["n_windows"], r["first_at"]) for r in decontam.contamination(documents(docs), bench).collect()}
    want = matched(docs, items)
    assert got == want and 40 < len(got)


# toxicity and quality

def _rows(n, seed, mark):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        y = rng.random() < 0.3
        if y:
            mark(w, rng)
        out.append((i, " ".join(w), int(y)))
    return out


def test_toxicity_learns_and_holds_out(spark, documents):
    rows = _rows(900, 1, lambda w, rng: w.insert(rng.randrange(len(w)), rng.choice(["nasty", "Vile!"])))
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (3, None, 1)], "doc_id bigint, toxic int, slots int")
    docs = documents([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "nasty"), (5002, "w " * 60_000)])
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.95
    assert got[5000]["predicted"] == 0 and got[5000]["score"] == got[5001]["score"] and len(got) == len(rows) + 3
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1 OR score <> 0").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_quality_keeps_clean_documents(spark, documents):
    def junk(w, rng):
        kind = rng.randrange(3)
        w[:] = [w[0]] * 60 if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [x + "%%%" for x in w]
    rows = _rows(600, 2, junk)
    labels = spark.createDataFrame([(i, 1 - y, "h") for i, _, y in rows if i % 3], "doc_id bigint, quality int, host string")
    docs = documents([(i, t, "en", f"s{i % 7}") for i, t, _ in rows] + [(5000, None, None, None), (None, "a", "en", "s"), (5001, "", "en", "s1")])
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 602 and got[5000]["host"] == ""
    assert np.mean([got[i]["keep"] == (not y) for i, _, y in rows]) > 0.98
    assert all(0 <= r["path_rate"] <= 1 for r in got.values())
    assert quality.classify(docs, labels.limit(0)).where("NOT keep").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_sparse_sites_lean_on_the_prior(spark):
    rows = [("a", 1000.0, 900.0), ("b", 1000.0, 500.0), ("c", 1.0, 0.0)]
    groups = spark.createDataFrame(rows, "host string, n double, good double").withColumn("above", F.lit(0.7))
    k = quality.strength(groups, "above")
    assert 0.5 < k < 50  # spread groups are trusted, one document is not
    same = spark.createDataFrame([("a", 100.0, 70.0), ("b", 100.0, 70.0)], "host string, n double, good double").withColumn("above", F.lit(0.7))
    assert quality.strength(same, "above") > 1e4


# mixing and URLs

def test_mixing_meets_the_marginals(spark, documents):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([20, 200, 900]), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"])) for i in range(400)]
    rows += [(1000, None, None, None), (None, "w", "en", "a"), (5, rows[5][1], rows[5][2], rows[5][3])]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == 402 and not [r for r in got if r["n_tokens"] == 0 and r["selected"]]
    weight = defaultdict(Counter)
    for r in got:
        for d in mixing.DIMS:
            weight[d][r[d]] += r["probability"] * r["n_tokens"]
    have = defaultdict(Counter)
    for r in got:
        for d in mixing.DIMS:
            have[d][r[d]] += r["n_tokens"]
    for d in mixing.DIMS:
        power = 0.0 if d == "topic" else mixing.TEMPER
        target = {k: v ** power for k, v in have[d].items() if v}
        total, all_w = sum(target.values()), sum(weight[d].values())
        for k, v in target.items():
            assert abs(weight[d][k] / all_w - v / total) < 1e-3
    assert max(r["probability"] for r in got) == pytest.approx(1)
    assert mixing.mix(documents([]).limit(0)).count() == 0


def test_url_filter_as_of(spark):
    log = [("bad", "host", "evil.com", "add", "2024-01-10"), ("bad", "host", "evil.com", "remove", "2024-02-01"),
           ("bad", "host", "evil.com", "add", "2024-03-01"), ("bad", "host", "evil.com", "add", "2024-03-05"),
           ("ads", "prefix", "ok.org/a/b", "add", "2024-01-01"), ("ads", "url", "ok.org/x", "add", "2024-01-01"),
           ("ads", "url", "ok.org/x", "remove", "2024-01-01"), ("bad", "host", None, "add", "2024-01-01"), ("bad", "host", "org", "oops", "2024-01-01")]
    entries = spark.createDataFrame(log, "list_name string, kind string, rule string, action string, listed string")
    asked = [("http://Sub.EVIL.com:80/p?q#f", "2024-01-10 00:00:00", True), ("https://evil.com", "2024-01-31 23:59:59", True),
             ("http://evil.com/", "2024-02-01 00:00:00", False), ("http://evil.com/", "2024-02-29 00:00:00", False),
             ("http://u:p@evil.com./", "2024-03-20 00:00:00", True), ("notevil.com/", "2024-03-20 00:00:00", False),
             ("ok.org/a/b/c", "2024-05-01 00:00:00", True), ("ok.org/a/bc", "2024-05-01 00:00:00", False), ("ok.org/x", "2024-05-01 00:00:00", False),
             (None, "2024-05-01 00:00:00", False), ("", "2024-05-01 00:00:00", False), ("evil.com", None, False), ("evil.com/" + "a/" * 500, "2024-01-15 00:00:00", True)]
    captures = spark.createDataFrame([(u, t, "x") for u, t, _ in asked * 2], "url string, fetched string, rule string")
    got = {(r["url"], str(r["fetched"]) if r["fetched"] else None): r for r in urls.judge(captures, entries).collect()}
    assert len(got) == len(asked)
    for u, t, bad in asked:
        assert (got[u, t]["n_lists"] > 0) == bad, (u, t)
    assert urls.judge(captures.limit(0), entries).count() == 0 and urls.judge(captures, entries.limit(0)).where("n_lists > 0").count() == 0


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_line_dedup", "op10_mixing"])
def test_query_matches_sql(spark, name):
    import os

    import check
    from voxelloom.llm.queries import ORACLE, QUERIES
    root = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    df = QUERIES[name](spark, root)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted(tuple(check.norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(tuple(check.norm(r[c]) for c in cols) for r in df.collect()) == want


def test_no_reserved_regex_surprises():
    assert re.compile(mixing.WORD).findall("a\tb\x0bc  d") == list("abcd")


def test_a_sweep_of_the_raking_joins_each_sum_once(spark):
    joins = {}

    class Seen(Work):
        def put(self, df, name):
            joins[name] = df._jdf.queryExecution().analyzed().toString().count("Join ")
            return super().put(df, name)
    counted = spark.createDataFrame([("a", "x", "s", 2, 30), ("b", "x", "l", 1, 10), ("b", "y", "s", 1, 60)],
                                    "source string, lang string, topic string, n_docs bigint, tokens bigint")
    target = lambda **share: spark.createDataFrame(list(share.items()), "value string, share double")
    targets = {"source": target(a=0.5, b=0.5), "lang": target(x=0.5, y=0.5), "topic": target(s=1.0)}
    got = {r["source"] + r["lang"]: r["weight"] for r in mixing.rake(counted, targets, Seen(spark, "t"), 3).collect()}
    assert got == pytest.approx({"ax": 50, "bx": 0, "by": 50}, abs=20) and got["bx"] == 0
    assert joins["sweep2"] <= 7   # three steps, each read by the sums of the later ones too
