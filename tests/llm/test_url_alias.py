import duckdb
import pyarrow as pa

from sparrowfold.llm import queries, url_alias
from sparrowfold.llm.common import Workspace
from sparrowfold.llm.components import connected_components
from sparrowfold.llm.url_alias import ORACLE_SQL, judge

PAGES = [
    (1, "https://a.example.com/en/1?x=1#f", '<link rel="canonical" href="https://other.test/home">'),
    (2, "http://Other.test/home#top", "<p>x</p>"),
    (3, "https://mirror.test/z", '<meta http-equiv="refresh" content="0; url=https://other.test/home">'),
    (4, "https://b.example.com/en/77", "<link rel='canonical' href='https://mirror.test/z'>"),
    (5, "ftp://x.net/de/", None), (6, "https://sub.example.net/de/8/a", ""), (7, "https://example.net/de/9", ""), (8, None, "canonical"), (9, "no scheme", ""), (9, "no scheme", ""),
    (10, "x://ORG/es/1", ""), (None, "https://free.test", ""), (11, "https://notcom/en/", ""), (12, "https://lone.test/a/b?c#d", '<link href="/a/c?d&amp;e" rel=canonical>'), (13, "https://lone.test/a/c?d&e", ""), (14, "https://x.com:80/en/", ""),
]
WANT = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "block", None: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow"}


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, verdict string")


def test_judgement(spark):
    got = judge(pages(spark, PAGES)).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: r.verdict for r in got} == WANT
    by = {r.page_id: r for r in got}
    assert [by[k].rule for k in (1, 2, 4, 6, 7)] == ["com/en/", None, "example.com/en/7", "example.net/de/8", "net/de/"]
    assert (by[2].host, by[2].path, by[9].host, by[9].path, by[8].host) == ("other.test", "/home", "", "", "")
    assert judge(pages(spark, [])).count() == 0


def test_many_rules_are_joined(spark, monkeypatch):
    rules = [*url_alias.RULES, ("allow", "com", "/en/"), ("block", "b.example.com", "/en/7"), ("allow", "test", "")]
    key = lambda rows: sorted(map(str, rows))
    one = key(judge(pages(spark, PAGES), rules).collect())
    monkeypatch.setattr(url_alias, "MAX_RULES", 0)
    assert key(judge(pages(spark, PAGES), rules).collect()) == one
    assert {r.page_id: r.verdict for r in judge(pages(spark, PAGES)).collect()} == WANT


def test_redirects_and_long_chains(spark):
    n = 60
    rows = [(k, f"https://h{k}.test/p", "") for k in range(n)] + [(n, "https://q.example.com/en/1", ""), (n + 1, "https://example.com/en/7", "")]
    moves = [(f"https://h{k}.test/p", f"https://h{k + 1}.test/p") for k in range(n - 1)] + [(f"https://h{n - 1}.test/p", "https://q.example.com/en/1"), ("https://example.com/en/7", "https://h3.test/p"), (None, "x"), ("https://a.test", "https://a.test")]
    got = judge(pages(spark, rows), redirects=spark.createDataFrame(moves, "from_url string, to_url string")).collect()
    assert {r.page_id: r.verdict for r in got} == {**{k: "block" for k in range(n + 1)}, n + 1: "allow"}


def test_against_sql(spark):
    rows = [r for r in PAGES if r[0] != 12]
    db = duckdb.connect()
    db.register("pages", pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    cur = db.execute(ORACLE_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(map(str, ([dict(zip(names, r))[c] for c in ("page_id", "host", "path", "rule", "verdict", "via")] for r in cur.fetchall())))
    assert sorted(str(list(r)) for r in judge(pages(spark, rows)).collect()) == want


def test_components_of_awkward_edges(spark):
    edges = [(5, 4), (4, 5), (4, 3), (9, 9), (None, 1), (7, None), (10, 20), (20, 30), (30, 11), (-1, 40)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()
    assert sorted(map(tuple, got)) == sorted([(5, 3), (4, 3), (3, 3), (10, 10), (20, 10), (30, 10), (11, 10), (-1, -1), (40, -1)])


def test_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    rows = [(1, "https://example.net/de/9", ""), (2, "ftp://x.net/de/", None), (3, "https://sub.example.net/de/8/a", ""), (4, "https://a.com/en/1", ""), (5, "https://b.example.com/en/77", ""), (6, "x://ORG/es/1", ""), (7, "https://net.test/de/", "")]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op4_url_alias(spark, str(tmp_path)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"), 6: ("org/es/", "block"), 7: (None, "allow")}
