"""The weights of op3 come from all documents, not from the shard that a document is in."""

import numpy as np

from tidewright.llm import packing, tokens


def test_statistics_are_those_of_all_documents(spark):
    texts = [f"the harbour lies {'east ' * (k % 3)}of the town {k}" for k in range(40)] + [None, ""]
    enc = tokens.encoder(tokens.default_tokenizer())
    ids = [np.frombuffer(x, enc.kind) for x in enc.encode([t or "" for t in texts])]
    table = spark.createDataFrame([(bytearray(x.tobytes()),) for x in ids], "ids binary").repartition(3)
    n, mean, df = packing.corpus_statistics(table, tokens.default_tokenizer())
    assert (n, mean) == (len(texts), sum(map(len, ids)) / len(texts))
    assert all(df[t] == sum(t in x for x in ids) for t in {t for x in ids for t in x.tolist()}) and df.sum() == sum(len(set(x.tolist())) for x in ids)


def test_a_term_common_in_the_shard_and_rare_elsewhere_has_weight():
    docs = [np.array([7, 8, 10 + k]) for k in range(4)]
    df = np.ones(20, np.int64)
    df[7], df[8] = 4, 900
    alone, among = packing.ShardIndex(docs), packing.ShardIndex(docs, corpus=(1000, 3.0, df))
    assert not alone.scores(0)[1] and among.scores(0)[1] > 0
    idf = np.log((1000 - 4 + 0.5) / (4 + 0.5))
    assert np.isclose(among.scores(0)[1], idf)
