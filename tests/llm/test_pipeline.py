"""The pipeline's stages and its whole run against plain versions, with nulls, empty texts and copies."""

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from wayfield.llm import robust_quality, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(5000, None, None, None, None), (5001, "", "en", "src0", 0), (5002, "the of", "en", "src0", 6), (5003, None, "fr", "src1", None)]
    copies = [(6000 + r.doc_id, *tuple(r)[1:]) for r in real.select("doc_id", "text", "lang", "source", "n_chars").limit(25).collect()]
    where = tmp_path_factory.mktemp("pipeline")
    rows = real.unionByName(spark.createDataFrame(odd + copies, "doc_id long, text string, lang string, source string, n_chars long"))
    rows.coalesce(1).write.parquet(f"{where}/documents.parquet")
    return str(where)


def plain_quality(rows):
    sound = []
    for d, t, lang, source in rows:
        n, chars, symbols, dup, repeat = brute.statistics(t)
        if n >= 50 and 2 * repeat <= n:
            lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
            sound.append((d, lang, source, [math.floor(1000 * x + 0.5) for x in (math.log(chars / n), math.log1p(10 * symbols / n), dup / lines, repeat / n)]))
    rq = robust_quality
    distances = brute.robust_distances(sound, np.array(rq.SAMPLING) * rq.SCALE, rq.KEEP_SHARE, rq.CONSISTENCY, rq.PRIOR)
    return {d for d, v in distances.items() if v <= rq.CUTOFF}


def plain_copies(rows):
    """Least doc_id of each component; empty sets stay."""
    found = brute.shingle_components([(d, t) for d, t, _, _ in rows])
    return {d for d, (n, component) in found.items() if n == 0 or d == component}


def plain_masked(text):
    spans = brute.secret_spans(text, secret_scan.CLASSES, secret_scan.ASSIGN, secret_scan.KINDS, secret_scan.ALLOWED)[1]
    out, at = "", 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return None if text is None else out + text[at:]


def plain_mixed(rows):
    return brute.mixed(rows, corpus_pipeline.MIX, lambda s: None if s is None else f"g{int(s[3:]) % 3}")


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: Counter(r.doc_id for r in stages[name](spark, docs, sf_dir).select("doc_id").collect())
    assert ids("quality_rules") == Counter(plain_quality(rows))
    assert ids("near_duplicates") == Counter(plain_copies(rows))
    assert ids("source_mixing") == plain_mixed(rows)
    masked = {r.doc_id: (r.text, r.n_chars) for r in stages["secret_scans"](spark, docs, sf_dir).collect()}
    assert masked == {d: (m := plain_masked(t), None if m is None else len(m)) for d, t, _, _ in rows}

    kept = plain_quality(rows)
    rows = [r for r in rows if r[0] in kept]
    kept = plain_copies(rows)
    want = plain_mixed([(d, plain_masked(t), lang, source) for d, t, lang, source in rows if d in kept])
    got = corpus_pipeline.run(spark, sf_dir).filter("start = 0").collect()
    assert 0 < len(want) < len(rows) and Counter(r.doc_id for r in got) == want


CLASHES = ("__text", "__content", "__of", "__row", "__g", "__lang", "n_words", "Kept", "distance", "epoch", "n_tokens", "__n", "__domain", "__id", "component", "cls", "row", "key", "document_row", "seq", "__all", "__base")


def test_stages_take_any_rows_and_columns(spark, tmp_path):
    """Columns named like helpers, a map, nulls, ties, repeated rows, a text of 20,000 words, and an empty table."""
    from pyspark.sql import functions as F

    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    long_text = " ".join(f"word{i % 50_000} and token=abcdef{i}" if i % 1000 == 0 else f"word{i * 7 % 50_000}" for i in range(20_000))
    rows = real + real[:5] + [(7000, long_text, "en", "src1", len(long_text)), (None, real[0][1], "en", "src1", 5), (7001, None, None, None, None), (7002, "", "en", None, 0), (7003, "secret=abcdefgh " + real[1][1], "en", "src2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit("keep "), F.col("doc_id").cast("string")) for c in CLASHES}).withColumn("tags", F.create_map(F.lit("k"), F.col("lang")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.select("doc_id", "text", *CLASHES).collect()
        assert got and all(r[c] == (None if r.doc_id is None else f"keep {r.doc_id}") for r in got for c in CLASHES), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    masked = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["secret_scans"](spark, docs, str(tmp_path)).collect()}
    assert "abcdefgh" not in "".join(str(x) for x in masked[7003]) and masked[7000].text.count("[SECRET]") == 20
    packed = corpus_pipeline.STAGES[-1][1]
    got = packed(spark, docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text")), str(tmp_path)).collect()
    assert len({(r.document_row, r.start) for r in got}) == len(got)
    assert packed(spark, docs.limit(0), str(tmp_path)).count() == 0
