"""URL rules and the classes of aliases, against SQL, against loops and by hand."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm.queries import ORACLE_SQL, QUERIES
from barspark.llm.urlfilter import judged, page_links, rule_table, ruled
from tests.llm.test_queries import duck, same

SCHEMA = "page_id long, url string, html string"


def link(target):
    return f'<html><head><link rel="canonical" href="{target}"></head></html>'


def verdicts(df):
    return {r.page_id: (r.rule, r.verdict) for r in df.collect()}


def test_links_that_sql_can_pick_out(spark, tmp_path):
    rows = [
        (1, "http://a.net/x#top", link("http://B.net/y?q=1#f")),
        (2, "https://b.net/y?q=1", '<meta http-equiv="refresh" content="0; url=http://c.example.com/de/3">'),
        (3, "http://d.net/", None),
        (4, "http://d.org/z", link("http://c.example.com/de/3")),  # its own allow holds
        (5, "http://e.net/1", link("http://e.net/2")),
        (6, "http://e.net/2", link("http://e.net/1")),
        (7, None, link("http://c.example.com/de/3")),
        (8, "no address", link("http://c.example.com/de/3")),
        (9, "http://example.org/es/1", ""),
        (10, "http://sub.EXAMPLE.org/en/12", ""),
        (11, "http://badexample.org/en/12", ""),
        (12, "http://x.org", ""),
        (1, "http://a.net/x#top", link("http://B.net/y?q=1#f")),
        (None, "http://w.com/fr/1?x=http://y.org/", ""),
    ]
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).toPandas().astype({"page_id": "Int64"}).to_parquet(f"{path}/pages.parquet")
    df = QUERIES["op13_redirect_equivalence"](spark, path)
    same(df, duck(path).sql(ORACLE_SQL["op13_redirect_equivalence"]))
    found = verdicts(df)
    assert {k: v for k, (_, v) in found.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "allow", 12: "allow", None: "allow"}
    assert found[10][0] == "example.org/en/1" and found[11][0] == "org/" and found[12][0] is None


def test_links_of_any_form(spark):
    html = (
        "<!-- <link rel=canonical href=http://no.net/1> --><script>'<link rel=canonical href=http://no.net/2>'</script>"
        "<base href='/deep/er/'><LINK HREF='../up?a=1&amp;b=2' REL='alternate CANONICAL'><link rel=stylesheet href=s.css>"
        "<meta content='5;URL=\"//other.net/p\"' HTTP-EQUIV=Refresh><meta http-equiv=refresh content=30><link rel=canonical href='http://[bad'>"
    )
    df = spark.createDataFrame([(1, "http://h.net/a/b", html)], SCHEMA)
    assert sorted(r.to_url for r in page_links(df).collect()) == ["http://h.net/deep/up?a=1&b=2", "http://other.net/p"]


def test_redirect_log_long_texts_empty_tables_and_other_columns(spark):
    rows = [(k, f"http://h{k}.net/", "<p>" + "x" * (2_000_000 if k == 3 else 1), "c") for k in range(6)]
    pages = spark.createDataFrame(rows, SCHEMA + ", root string")
    log = spark.createDataFrame([(f"http://h{k}.net/", f"http://h{k + 1}.net/") for k in range(3)] + [("http://h3.net/", "http://a.com/de/" + "y" * 100_000), (None, "http://h5.net/")], "from_url string, to_url string")
    found = judged(pages, redirects=log)
    assert {r.page_id: r.verdict for r in found.collect()} == {0: "block", 1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "alias_of"]
    assert judged(pages.limit(0)).count() == 0
    no_rules = rule_table(spark).limit(0)
    assert {r.verdict for r in judged(pages, no_rules, log).collect()} == {"allow"}


HOSTS = [".".join(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(HOSTS), st.text("/x", max_size=3), st.sampled_from(["allow", "block"])), max_size=12))
def test_longest_rule_wins(spark, rules):
    spots = [(h, p) for h in HOSTS for p in ("", "/", "/x", "//x", "/x/x", "/xx/")]
    table = spark.createDataFrame([(f"{h}/{p}", v) for h, p, v in rules], "rule string, verdict string")
    found = {(r.host, r.path): (len(r.rule), r.verdict) for r in ruled(spark.createDataFrame(spots, "host string, path string"), table).collect()}
    for h, p in spots:
        fits = [(len(f"{a}/{b}"), len(a), v == "allow", v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith("/" + b)]
        assert found.get((h, p)) == ((max(fits)[0], max(fits)[3]) if fits else None)


def test_aliases_against_a_loop(spark):
    import random

    rng = random.Random(3)
    hosts = [f"h{k}.net" for k in range(40)] + ["b.com"]
    url = lambda h: f"http://{h}/de/"
    log = [(url(rng.choice(hosts)), url(rng.choice(hosts))) for _ in range(24)] + [(url("b.com"), url("h0.net"))]
    parent = {h: h for h in map(url, hosts)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in log:
        parent[root(u)] = root(v)
    pages = spark.createDataFrame([(k, url(h), None) for k, h in enumerate(hosts)], SCHEMA)
    found = {r.page_id: r.verdict for r in judged(pages, redirects=spark.createDataFrame(log, "from_url string, to_url string")).collect()}
    assert found == {k: "block" if root(url(h)) == root(url("b.com")) else "allow" for k, h in enumerate(hosts)}


@pytest.mark.parametrize("n", [3000])
def test_one_address_with_many_rows(spark, n):
    pages = spark.range(n).selectExpr("id AS page_id", "'http://hot.net/' AS url", "'<link rel=\"canonical\" href=\"http://q.com/de/\">' AS html")
    assert judged(pages).where("verdict = 'block'").count() == n
