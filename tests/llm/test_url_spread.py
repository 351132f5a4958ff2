"""Trust and distrust reach hosts many links away from every seed."""

from cartoframe.llm import url_filter


def test_distrust_reaches_a_host_twelve_links_away(spark):
    n = 12
    rows = [(i, f"http://h{i}.test/", f'<a href="http://h{i + 1}.test/">') for i in range(n)] + [(n, f"http://h{n}.test/", '<a href="http://com/en/1">'), (n + 1, "http://com/en/1", None)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].distrust > 0 and got[0].verdict == "block"
    rank = url_filter.UNIT * 15 // 100
    for i in range(n, -1, -1):
        rank = rank * 85 // 100
        assert got[i].distrust == rank
