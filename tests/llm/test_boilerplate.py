"""op7 against counting in plain Python, and its query against SQL."""

from collections import Counter

import duckdb
import pytest
from llm_helpers import DATA, clash, documents

from tastemap.llm.boilerplate import drop_boilerplate


def brute(rows, ratio, least):
    pages = Counter(h or "" for _, _, h in rows)
    on = Counter((h or "", line) for _, t, h in rows if t is not None for line in set(t.split("\n")))
    out = []
    for doc, text, host in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [
            x for x in lines
            if not x.strip(" ") or not (on[host or "", x] >= least and on[host or "", x] > ratio * pages[host or ""])
        ]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


ROWS = (
    [(i, f"menu\nown {i}\n\nfoot\nfoot", "a") for i in range(20)]
    + [(20 + i, f"menu\nown {i}\n " + ("half\n" if i % 2 else ""), "b") for i in range(10)]
    + [(40, "menu", "c"), (41, None, "c"), (42, "", "c"), (43, "menu", None), (44, "menu\nx", None), (None, "menu", None)]
    + [(50, "a\n" * 30_000, "d"), (51, "same", "a"), (51, "same", "a"), (51, "same", "a")]
)


@pytest.mark.parametrize("ratio,least", [(0.1, 5), (0.5, 1), (0.9, 3), (0.0, 1)])
def test_equals_counting(spark, ratio, least):
    df = clash(documents(spark, ROWS).repartition(3))
    got = drop_boilerplate(df, ratio=ratio, least=least)
    assert sorted(got.columns) == sorted([*df.columns, "n_lines", "n_dropped"])
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert rows == brute(ROWS, ratio, least)


@pytest.mark.parametrize("pages", [3, 10, 49, 50, 120])
def test_the_ratio_decides_on_hosts_of_any_size(spark, pages):
    """A line on a tenth of the pages stays, one on a page more goes."""
    tenth = pages // 10
    rows = []
    for i in range(pages):
        lines = [f"own {i}"] + ["often"] * (i <= max(1, tenth)) + ["seldom"] * (i < tenth) + ["menu"]
        rows.append((i, "\n".join(lines), "h"))
    got = drop_boilerplate(documents(spark, rows))
    left = "\n".join(r.text for r in got.collect()).split("\n")
    assert "menu" not in left and "often" not in left
    assert left.count("seldom") == tenth and sum(x.startswith("own") for x in left) == pages


def test_no_rows(spark):
    assert drop_boilerplate(documents(spark, [])).collect() == []


def test_no_python(spark):
    plan = drop_boilerplate(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_query_equals_sql(spark, scale):
    from tastemap.llm import ORACLE_SQL, QUERIES

    directory = f"{DATA}/{scale}"
    got = QUERIES["op7_boilerplate"](spark, directory).toArrow().to_pylist()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS FROM '{directory}/pages.parquet'")
        expected = c.sql(ORACLE_SQL["op7_boilerplate"]).to_arrow_table().to_pylist()
    order = lambda r: r["page_id"]
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert 0 < sum(r["n_dropped"] for r in got) < sum(r["n_lines"] for r in got)
