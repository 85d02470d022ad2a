import duckdb

from mnemolake.llm.line_dedup import ORACLE_SQL, line_dedup
from tests.llm.common import documents, sample, words


def brute(rows):
    first, found = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x)):
        lines = t.split("\n")
        at = [k for k, line in enumerate(lines) if words(line)]
        gone = set()
        for j in range(len(at) - 2):
            key = tuple(lines[k] for k in at[j : j + 3])
            if first.setdefault(key, (i, j)) != (i, j):
                gone.update(at[j : j + 3])
        found[i, t] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return sorted(((i, *found.get((i, t), (0, 0, None))) for i, t in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_removed_lines", "text").collect()), key=str)


def test_sample_against_sql_and_brute_force(spark):
    docs = sample(spark, "sf0.01")
    got = result(line_dedup(docs))
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL).fetchall(), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in got) > 0


def test_edges(spark):
    long = "\n".join(f"line {k} é" for k in range(20000))
    texts = ["a\nb\nc\nd", "x\na\n \nb\nc\ny", None, "", "a\nb", "k\n" * 9, "a\nb\nc\nd", long, long, "q\nr\ns", "q\nr\ns"]
    ids = [3, 5, 6, 7, 8, 9, 3, 20, 21, None, 4]
    docs = documents(spark, texts, ids=ids)
    assert result(line_dedup(docs)) == brute(list(zip(ids, texts)))


def test_columns(spark):
    docs = documents(spark, ["a\nb\nc", "a\nb\nc"]).selectExpr("*", "1 AS n_lines", "2 AS h", "3 AS pos", "4 AS `a.b`", "5 AS _lines", "6 AS _covered", "7 AS _pos", "8 AS _line_th", "9 AS _gone_id")
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "pos", "a.b", "_lines", "_covered", "_pos", "_line_th", "_gone_id", "n_lines", "n_removed_lines"]
    assert [(r._lines, r._covered, r._pos, r._line_th, r._gone_id) for r in out.collect()] == [(5, 6, 7, 8, 9)] * 2
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["a\nb\nc", ""]
    assert line_dedup(documents(spark, [])).count() == 0
