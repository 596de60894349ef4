"""The pipeline stage by stage against brute force, and rows that stay the same rows however scans are split."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillstone.llm.registry")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillstone.llm import op3_decontamination, op5_substring_dedup, op6_exact_dedup, op8_jaccard_join, op9_quality, scratch  # noqa: E402

RNG = np.random.default_rng(11)
VOCABULARY = [f"{a}{b}" for a in ("ro", "li", "ma", "te", "su") for b in ("n", "lt", "ver", "cke", "d", "sta")]
SCHEMA = "doc_id long, text string, lang string, score double, Predicted int, __row string, __file int, _metadata string"


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n)).capitalize() + "."


ITEM = prose(14)


def _rows():
    texts = [prose(int(n)) for n in RNG.integers(20, 90, 150)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + " x", None, None, "", " ", "two words", "Before it " + ITEM + " " + prose(30), prose(6000)]
    texts += ["$$ !!! @@ ## " * 12] * 3 + ["%% && ** " * k for k in range(20, 60)]
    near = texts[2].split()
    texts += [" ".join([*near, "more"]), " ".join([*near, "more", "words"])]
    rows = [(k, t, "en", 0.25, 7, "r", 3, "m") for k, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[4], "en", None, None, None, None, None)]


TABLE = _rows()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(TABLE, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    good = [(r[0], 0 if "!!" in (r[1] or "") or "%%" in (r[1] or "") else 1) for r in TABLE if r[0] is not None and r[1]]
    spark.createDataFrame(good, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", ITEM), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def key(r):
    return tuple((x is not None, x) for x in r)


def grams(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def exact(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), r)
    return list(best.values())


def near(rows):
    sets, label = [grams(r[1]) for r in rows], list(range(len(rows)))
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and len(a & b) >= 0.8 * len(a | b):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    classes = {}
    for r, c in sorted(zip(rows, label, strict=True), key=lambda x: (x[0][0] is None, x[0][0])):
        classes.setdefault(c, r)
    return list(classes.values())


def words(text):
    return op3_decontamination.words(text)


def clean(rows):
    item = words(ITEM)
    wanted = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    return [r for r in rows if not any(tuple(w[i : i + 10]) in wanted for w in [words(r[1])] for i in range(len(w)))]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = op6_exact_dedup.groups(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = {(r.doc_id, r.text): r.predicted for r in op9_quality.score(docs.select("doc_id", "text"), labels).collect()}
    steps = {"quality": lambda rows: [r for r in rows if scored[r[0], r[1]] == 1], "exact_dedup": exact, "near_dedup": near, "decontamination": clean}
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(rows, key=key) == sorted(TABLE, key=key)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        expected = steps[name](rows)
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = [tuple(r) for r in docs.collect()]
        assert sorted(got, key=key) == sorted(expected, key=key), name
        assert 0 < len(got) < len(rows), name
        rows = got
    assert not any("!!" in (r[1] or "") for r in rows) and any(len(r[1] or "") > 20_000 for r in rows)
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert packed.length.sum() == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    by = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert whole[["doc_id", "start", "length", "ids_crc32"]].sort_values(by[:4]).values.tolist() == packed[by[:4]].sort_values(by[:4]).values.tolist()
    assert earlier.count() == len(TABLE)  # a run deletes none but its own tables


def test_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None)] * 3, SCHEMA)
    assert op6_exact_dedup.deduplicate(nulls).count() == 1 and op8_jaccard_join.deduplicate(nulls).count() == 3


def test_scans_split_in_other_ways(spark, sf_dir, monkeypatch):
    """Every table that is written between two steps changes how files are split; results stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = [
        lambda: op5_substring_dedup.substring_dedup(docs).collect(),
        lambda: op6_exact_dedup.groups(docs).drop("__file").collect(),
        lambda: op6_exact_dedup.deduplicate(docs).collect(),
        lambda: op8_jaccard_join.classes(docs).drop("__file").collect(),
        lambda: op8_jaccard_join.deduplicate(docs).collect(),
        lambda: corpus_pipeline.decontaminate(spark, docs, sf_dir).collect(),
    ]
    before = [sorted((tuple(r) for r in run()), key=key) for run in runs]
    keep, turn = scratch.keep, itertools.count()

    def changing(df, name, codec="zstd"):
        k = next(turn) % 3
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + 3 * k))
        spark.conf.set("spark.sql.files.maxPartitionBytes", ("4k", "64k", "128m")[k])
        return keep(df, name, codec)

    monkeypatch.setattr(scratch, "keep", changing)
    try:
        assert [sorted((tuple(r) for r in run()), key=key) for run in runs] == before
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_that_a_polynomial_confuses(spark):
    """Two different words of 1,024 letters whose sums of powers agree modulo 2^64 are two words."""
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, " ".join([one] * 25)), (2, " ".join([two] * 25))], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in op5_substring_dedup.substring_dedup(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 24, 2: 24} and got[2][1] == two
    assert {r.doc_id: r.n_links for r in op8_jaccard_join.classes(docs).collect()} == {1: 0, 2: 0}


def test_windows_with_one_digest(spark, monkeypatch):
    """Windows are compared word by word: with a digest that is the same for all, nothing but repeats goes."""
    from quillstone.llm import recompress

    ids = RNG.integers(0, 2, 400).astype(np.int32)
    at = np.arange(0, 390)
    by, head = recompress.equal_windows(ids, at, np.zeros(len(at), np.uint64), 8, at)
    groups = np.cumsum(head)
    seen = {}
    for g, w in zip(groups, at[by], strict=True):
        assert seen.setdefault(tuple(ids[w : w + 8]), g) == g
    assert len(seen) == groups[-1]


def test_texts_with_one_digest(spark):
    """A weak digest sends different texts to one key; whole texts tell them apart."""
    rows = [(k, t) for k, t in enumerate(["aa", "a a", "ab", "b", "b ", None, "", "ba"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda text: F.substring(F.concat(text, F.lit("-")), 1, 1).cast("binary")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = [sorted(map(tuple, op6_exact_dedup.groups(docs, digest=d).select(columns).collect())) for d in (weak, op6_exact_dedup._sha256)]
    assert got[0] == got[1] and sum(r[3] for r in got[0]) == 5


def test_state_of_earlier_runs(spark, tmp_path):
    """A second run over more files meets the rows of the first."""
    first, second = [(1, "one  text"), (2, "two"), (3, None)], [(4, "onetext"), (5, "three"), (6, " t w o "), (7, "")]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}")
    run = lambda name: {r.doc_id: (r.keep_id, r.group_size) for r in op6_exact_dedup.groups(spark.read.parquet(f"{tmp_path}/{name}"), state=f"{tmp_path}/state").collect()}
    assert run("a") == {1: (1, 1), 2: (2, 1), 3: (3, 1)}
    assert run("b") == {4: (1, 2), 5: (5, 1), 6: (6, 2), 7: (3, 2)}
