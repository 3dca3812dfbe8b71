"""Views, caches, first contents and reports."""

from lodestrata.plans.session import ResultCache, bootstrap, register_views, report


def test_views_can_be_named_in_sql(spark, small):
    names = register_views(spark, small, "v_")
    assert "v_facts" in names and spark.sql("SELECT count(*) AS n FROM v_facts f JOIN v_documents d ON f.fact_id = d.doc_id").first().n == 200


def test_cache_keeps_the_last_and_the_fresh(spark):
    now, made = [0.0], []
    cache = ResultCache(2, 10, lambda: now[0])

    def make(k):
        made.append(k)
        return spark.range(k)

    for k in (1, 2, 1, 3, 2):
        assert cache.get(k, lambda k=k: make(k)).count() == k
    assert made == [1, 2, 3, 2]
    now[0] = 11
    cache.get(2, lambda: make(2))
    assert made[-1] == 2 and len(made) == 5
    cache.clear()


def test_bootstrap_and_report(spark):
    some, none = spark.createDataFrame([(1, "a<b")], "k int, t string"), spark.createDataFrame([], "k int, t string")
    assert bootstrap(none, some).count() == 1 and bootstrap(some, none).count() == 1
    assert report(some) == "k\tt\n1\ta<b"
    assert report(some, "markdown").splitlines()[-1] == "| 1 | a<b |"
    assert "<td>a&lt;b</td>" in report(some, "html")
