"""Columns with the names of results, null and repeated ids, through every operator and stage."""

from collections import Counter

import numpy as np
import pytest

from voxelgrain.llm import ann, bpe, langid, mixing, quality, rules, toxicity, urls
from voxelgrain.llm.entries import TOKENIZER

NAMES = ["score", "Kept", "n_words", "distance", "_times", "_id", "_scored", "_text", "_row", "_copy", "taken", "size", "bin", "key", "lang_pred", "ids", "host", "rule"]


@pytest.fixture(scope="module")
def crowded(spark, small):
    """Documents with clashing columns, null and repeated ids and repeated rows."""
    d = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").drop("n_chars")
    long = "".join(f"long word{i} of a very long text number {i * 7919 % 1000} " for i in range(30_000))
    odd = spark.createDataFrame([(None, "a null id and ten more words to pass the base rules here now", "en", "web"), (3, None, None, None), (4, "", "en", "web"), (5, long, "de", "web"), (5, long, "de", "web")], "doc_id long, text string, lang string, source string")
    d = d.unionByName(odd).unionByName(odd)
    return d.selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES])




def test_operators_keep_columns_named_like_results(spark, crowded):
    n = crowded.count()
    empty = (np.zeros(0, np.int64), np.zeros(0))
    runs = {
        "toxicity": toxicity.score(crowded, empty, [*crowded.columns]),
        "quality": quality.score(crowded, None, np.zeros((1 << 16, 32), np.float32), [*crowded.columns]),
        "langid": langid.predict(crowded, ([], np.zeros((0, 1 << 15))), [*crowded.columns]),
        "rules": rules.judge(crowded, [*crowded.columns]),
        "bpe": bpe.encode(crowded, TOKENIZER, [*crowded.columns]),
        "mixing": mixing.mix(crowded, keep=[*crowded.columns]),
        "urls": urls.judge(crowded.withColumnRenamed("text", "url"), keep=[c for c in crowded.columns if c != "text"]),
    }
    for name, out in runs.items():
        assert out.count() == n, name
        row = out.first().asDict()
        for c in NAMES:
            assert c in (row.get(c), row.get(f"{c}_in"), row.get(f"{c}_in_in")), (name, c)
    assert runs["toxicity"].first()["score_in"] == "score" and isinstance(runs["toxicity"].first()["score"], float)


def test_stages_carry_every_row_for_itself(spark, small, crowded):
    import corpus_pipeline as p

    key = lambda r: (r["doc_id"], r["text"])
    start = Counter(map(key, crowded.collect()))
    for name, f in p.STAGES[:-1]:
        out = f(spark, crowded, small)
        assert out.columns == crowded.columns, name
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in NAMES), name
        got = Counter(map(key, rows))
        most = 2 if name == "mix_sources" else 1
        assert all(got[k] <= most * start[k] for k in got), name
    # copies of one text under one id: one row stays
    dedup = Counter(map(key, p.drop_copies(spark, crowded, small).collect()))
    assert max(v for k, v in dedup.items() if k[1] and k[0] is not None) == 1


def test_mixing_takes_rows_with_null_and_repeated_ids_one_by_one(spark):
    import corpus_pipeline as p

    rows = [(None, f"text number {i} has some words", "web") for i in range(60)] + [(7, f"repeated id {i} with words", "web") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r["text"] for r in p.mix_sources(spark, docs, "").collect())
    taken = {r["text"]: -(-r["taken"] // r["size"]) for r in mixing.mix(docs, keep=["text"]).collect()}
    assert got == {t: k for t, k in taken.items() if k} and set(got.values()) == {1, 2}


def test_functions_of_workers_need_no_package(spark, tmp_path):
    """What op6 ships runs in a process that can't import the library."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    r = np.random.default_rng(0)
    model = ann.learn(r.normal(size=(300, 8)), 5)
    (tmp_path / "f").write_bytes(cloudpickle.dumps((ann._search, ann._to_bytes, model)))
    code = f"""
import pickle, numpy as np, pyarrow as pa
search, to_bytes, model = pickle.load(open({str(tmp_path / "f")!r}, 'rb'))
x = np.random.default_rng(1).normal(size=(50, 8))
t = pa.table({{'block': [0] * 50, 'q_block': [0] * 50, 'query': [i < 5 for i in range(50)], 'id': list(range(50)), 'row': list(range(50)), 'v': [v.tobytes() for v in x]}})
assert search(t, model, 3).num_rows == 15
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
