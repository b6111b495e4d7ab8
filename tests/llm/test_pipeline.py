import hashlib
import os

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, decontaminate, quality, secrets, simhash
from tessera.llm.common import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = before, docs
        assert docs.columns == columns or name == "tokenize"
    texts = lambda t: {r.doc_id: r.text for r in t.collect()}

    before, after = map(texts, kept["quality"])
    model = quality.train(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    good = {i for i, t in before.items() if model.scores(quality.features((t or "").encode())[None].astype(float))[0] >= 0.3}
    assert set(after) == good and 0 < len(good) < len(before)

    before, after = map(texts, kept["near_duplicates"])
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in before.items()}
    reach = {i: i for i in fps}
    for _ in fps:
        reach = {i: min(reach[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
    assert set(after) == {i for i in fps if reach[i] == i}

    before, after = map(texts, kept["decontaminate"])
    items = [decontaminate.words(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    joined = [b" " + b" ".join(w) + b" " for w in items]
    holds = {i for i, t in before.items() if any(j in b" " + b" ".join(decontaminate.words(t)) + b" " for j in joined)}
    assert not holds & set(after) and len(after) >= 0.9 * (len(before) - len(holds))

    before, after = map(texts, kept["secrets"])
    assert set(before) == set(after)
    for i, t in before.items():
        assert (after[i] == t) == (not secrets.find(t)[1])
        assert not secrets.base_parts(after[i])

    before = texts(kept["tokenize"][0])
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in kept["tokenize"][1].collect():
        ids = library.encode_ordinary(before[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
    assert kept["tokenize"][1].count() == len(before)


def test_columns_of_any_name_stay(spark):
    docs = read_table(spark, SF, "documents").selectExpr("doc_id", "text", "lang", "source", "n_chars", "'keep-me' AS score", "7 AS predicted", "1 AS `a.b`", "2 AS `c``d`", "3 AS anchor")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns and [t for c, t in docs.dtypes if c != "n_chars"] == [t for c, t in before.dtypes if c != "n_chars"], name
    row = docs.first()
    assert (row["score"], row["predicted"], row["a.b"], row["c`d"]) == ("keep-me", 7, 1, 2)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
