import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import similar_lines
from voxelloom.llm import mixing, simhash
from voxelloom.llm.common import words

BENCH = "which of the seven old bridges over the river was closed first when the great flood came to town in spring"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Tables with clean documents, junk, copies, near copies, shared passages and a leaked benchmark item."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]

    def line(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    docs, kind = [], {}

    def add(text, what, lang="en"):
        i = len(docs)
        docs.append((i, text, lang, f"s{rng.randrange(4)}", len(text)))
        kind[i] = what
    for _ in range(120):
        add("\n".join(line(rng.randint(12, 60)) for _ in range(3)) + ".", "clean", rng.choice(["en", "de"]))
    for _ in range(60):
        add(rng.choice([" ".join([line(1)] * 50), line(40).upper().replace(" ", "!! ") + "!!", line(40).replace(" ", "%%% ")]), "junk")
    passage = line(60)
    for _ in range(5):
        add(f"{line(30)}\n{passage}\n{line(30)}", "shared")
    for _ in range(3):
        add(docs[3][1], "copy")
    near = line(400).split()
    for k in range(6):
        w = list(near)
        for _ in range(2):
            w[rng.randrange(400)] = rng.choice(vocab)
        # another line break each time, so that no line repeats another
        add("\n".join(" ".join(w[a:b]) for a, b in zip([0, *range(37 + 11 * k, 400, 90 + 7 * k)], [*range(37 + 11 * k, 400, 90 + 7 * k), 400])), "near")
    add(f"{line(20)} {BENCH} {line(20)}", "leak")
    root = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(what != "junk"), 0) for i, what in kind.items() if rng.random() < 0.7]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, kind


def test_every_stage_against_brute_force(spark, world):
    root, docs, kind = world
    frame = spark.read.parquet(f"{root}/documents.parquet")
    state = {d[0]: d[1] for d in docs}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination",
                            "mixing sources to target weights"]

    def after(name, df):
        out = stages[name](spark, df, root)
        if name != "mixing sources to target weights":
            assert out.columns == frame.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    df, got = after("quality classifier", frame)
    state = {i: t for i, t in state.items() if kind[i] != "junk"}
    assert got == state

    df, got = after("line dedup", df)
    bad = similar_lines(state.items())
    cut = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in bad) for i, t in state.items()}
    state = {i: t for i, t in cut.items() if t.strip() or not state[i].strip()}
    assert got == state and any(kind[i] == "shared" for i, _ in bad) and not any(kind[i] == "copy" for i in state)
    assert all(r["n_chars"] == len(r["text"]) for r in df.collect())

    df, got = after("SimHash near-dedup", df)
    fps = {i: simhash.fingerprint(t.encode()) for i, t in state.items()}
    split = {i: words(t.encode()) for i, t in state.items()}
    sets = {i: {tuple(w[n:n + 5]) for n in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    top = {i: i for i in fps}
    for i in sorted(fps):
        for j in sorted(fps):
            near = j < i and (bin(fps[i] ^ fps[j]).count("1") <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
            if near and sets[i] and sets[j]:
                a, b = top[i], top[j]
                top = {k: min(a, b) if v in (a, b) else v for k, v in top.items()}
    state = {i: t for i, t in state.items() if top[i] == i}
    assert got == state

    df, got = after("benchmark decontamination", df)
    state = {i: t for i, t in state.items() if kind[i] != "leak"}
    assert got == state

    df, got = after("mixing sources to target weights", df)
    for r in mixing.mix(spark.createDataFrame([d[:1] + (state[d[0]],) + d[2:] for d in docs if d[0] in state], frame.schema)).collect():
        u = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert (r["doc_id"] in got) == (u < r["probability"] and r["n_tokens"] > 0)
    whole = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, root).collect()}
    assert whole == got


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, world, name):
    root, docs, _ = world
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = [(None, "no id", "en", "s1", 5), (9001, None, "en", "s1", None), (9002, "", None, None, 0), (9003, "x " * 60_000, "en", None, 120_000),
           (9004, " \n\t ", "de", "s2", 4)]
    df = spark.createDataFrame(docs[:40] + docs[:2] + odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.withColumns({c: F.lit("clash") for c in ("bad", "cut", "label", "path", "drawn", "n_tokens", "keep", "h", "w")})
    out = stage(spark, df, root)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert None not in ids and len(ids) >= 5
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    empty = stage(spark, df.limit(0), root)
    assert empty.count() == 0


def test_near_stage_joins_copies_of_jaccard(spark):
    rng = random.Random(4)
    docs, sets = [], {}

    def add(w):
        docs.append((len(docs), " ".join(w), "en", "s", 1))
        sets[len(docs) - 1] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 60, 300, 1000]))]
        add(base)
        for rate in (0, 0.01, 0.02, 0.04):
            add([f"w{rng.randrange(3000)}" if rng.random() < rate else x for x in base])
    top = {i: i for i in sets}
    fps = {i: simhash.fingerprint(d[1].encode()) for i, d in enumerate(docs)}
    missed = 0
    for i in sets:
        for j in range(i):
            near, close = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]), bin(fps[i] ^ fps[j]).count("1") <= 3
            missed += near and not close
            if near or close:
                a, b = top[i], top[j]
                top = {k: min(a, b) if v in (a, b) else v for k, v in top.items()}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, "").collect()}
    assert got == {i for i in top if top[i] == i} and missed > 20


def test_line_stage_takes_short_lines(spark):
    texts = ["All rights reserved.\nfirst text\nHome", "second\nall rights reserved.\n\nhome", "home", "\n\nthird\nRESERVED. rights all"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, df, "").collect()}
    assert got == {0: texts[0], 1: "second\n", 3: "\n\nthird"}
