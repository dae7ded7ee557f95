"""op4 stores links once: each small table of a crowded input is as many files as there are tasks."""

from larkspur.llm import minhash
from larkspur.llm.common import Tables


class Counted(Tables):
    def cut(self, df):
        self.__dict__.setdefault("columns", []).append(df.columns)
        return super().cut(df)


def test_links_are_stored_once(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (3, " ".join(words[:-1] + ["y"])), (4, "another text of some six words")]
    tables = Counted(spark, "t")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), tables, 85).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True)}
    # pairs to compare first, pairs left, links found late; the first links go to the components as they are
    assert tables.columns.count(["u", "v"]) == 3
