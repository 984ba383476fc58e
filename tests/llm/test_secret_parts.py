"""Random keys that stand behind ordinary text within one run of characters, or are short."""

from helpers import SF, documents

from quern.llm import secret_scan as S
from quern.llm.common import table

KEY, SHORT = "q7Zp0XvT3mKd9RfYw2LhB6sN", "Zk4v9QxT2mWb7RjYp3H"


def test_keys_within_longer_runs(spark):
    model = S.train(S.labelled(table(spark, SF, "documents")).unionByName(S.synthetic(spark)))
    path, name = "/home/application/services/authentication/production/", "the-internationalization-of-the-documentation-service-"
    texts = [f"é {path}{KEY} x", f"see {name}{SHORT}", f"a {SHORT} b", f"{path}more", name, "an internationalization here", f"AKIA{'Q' * 16}/{KEY}"]
    rows = S.scan(documents(spark, texts), model).select("doc_id", S.listed(S.F.col("spans")).alias("s")).collect()
    got = {r["doc_id"]: r["s"] for r in rows}
    assert got[0] == f"markov:{2 + len(path)}:{2 + len(path) + len(KEY)}"
    assert got[1] == f"markov:{4 + len(name)}:{4 + len(name) + len(SHORT)}"
    assert got[2] == f"markov:2:{2 + len(SHORT)}"
    assert got[3] == got[4] == got[5] == ""
    assert got[6] == f"access:0:20,markov:21:{21 + len(KEY)}"
