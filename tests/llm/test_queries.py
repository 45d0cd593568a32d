"""Every dealt query and the pipeline on edge tables, and against SQL where there is some."""

import hashlib

import pytest

import corpus_pipeline
from stockloom.llm import common
from stockloom.llm.queries import ORACLE, QUERIES
from tests.test_oracle import rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op13_threshold_topk"}))
def test_edge_tables(spark, edge_dir, name):
    got = QUERIES[name](spark, edge_dir["edge"]).select("doc_id").collect()
    given = spark.read.parquet(f"{edge_dir['edge']}/documents.parquet").select("doc_id").collect()
    assert sorted(map(str, got)) == sorted(map(str, given))
    assert QUERIES[name](spark, edge_dir["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_edge_tables_match_sql(spark, edge_dir, name):
    """All but the very long text, whose nested lists the SQL engine copies word by word."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{edge_dir['edge']}/documents.parquet/*.parquet' WHERE doc_id <> 11 AND coalesce(length(text), 0) < 10000")
    for other in ("benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {other} AS SELECT * FROM '{edge_dir['edge']}/{other}.parquet/*.parquet'")
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    folder = common.scratch(spark)
    spark.read.parquet(f"{edge_dir['edge']}/documents.parquet").filter("doc_id <> 11 AND coalesce(length(text), 0) < 10000").write.parquet(f"{folder}/documents.parquet")
    for other in ("benchmark", "embeddings"):
        spark.read.parquet(f"{edge_dir['edge']}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
    df = QUERIES[name](spark, folder)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_pipeline_stage_contracts(spark, edge_dir):
    for name, folder in edge_dir.items():
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.saved(stage(spark, docs, folder))
            assert docs.columns == list(corpus_pipeline.DOCUMENTS)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert out.count() == docs.count() and (name == "edge") == (out.count() > 0)


def jaccard_roots(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for k, t in texts.items():
        w = t.translate(LOWER).split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by: dict = {}
    for k, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in texts}


def test_pipeline_against_brute_force(spark, sf):
    """Each stage's decisions, worked out plainly from what the stage before it kept."""
    import base64

    import public_tokenizers
    import tiktoken

    from stockloom.llm import quality_nbsvm, source_raking

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_quality_nbsvm"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    left = {k: t for k, t in texts.items() if scores[k] == 1}
    last: dict = {}
    for k in sorted(left):
        last[left[k].translate(LOWER)] = k
    left = {k: left[k] for k in last.values()}
    left = {k: left[k] for k, r in jaccard_roots(left).items() if k == r}
    kept = docs.filter(docs.doc_id.isin(list(left)))
    picked = {r.doc_id for r in source_raking.mix(kept).collect() if int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32 < r.mix_probability}
    assert quality_nbsvm.ACCEPT == 0.3 and picked
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {k: own.encode_ordinary(left[k]) for k in picked}
