"""The views keep every row that they map."""

from graphloom.plans.catalog import CATALOG
from graphloom.plans.views import frames


def test_violations_of_every_source(spark, tmp_path):
    docs = [(1, "plain words", "en", "src1", 11), (2, "a secret", "en", "src3", 8), (3, "under license", "en", "src3", 13), (4, "well!!", "en", "src2", 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    f = frames(spark, str(tmp_path))
    got = {(r.root_id, r.kind): r.n for r in CATALOG["subset_by_root"][0](f).collect()}
    assert got == {("src3", "unsafe"): 1, ("src3", "eval"): 1, ("src2", "with"): 1}
    gate = {r.bucket: (r.violations, r.eligible) for r in CATALOG["scoped_sound_candidates"][0](f).collect()}
    assert gate == {"src1": (0, True), "src2": (1, False), "src3": (2, False)}


def test_every_imported_package_is_asked_for(spark):
    f = frames(spark, "/root/testdata/sf0.001")
    named = {r.module.split("/")[0] for r in f["g_refs"].where("kind = 'import' AND module LIKE 'pkg%'").select("module").distinct().collect()}
    got = {r.query for r in CATALOG["importers_of_every_package"][0](f).select("query").distinct().collect()}
    assert got == named and len(named) == 50


def test_every_subscription_is_dispatched(spark, tmp_path):
    # The only handler of user 7 subscribes in an event whose id is 3 modulo 4.
    spark.createDataFrame([(2, 1, "click"), (3, 7, "click")], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = CATALOG["event_dispatch"][0](frames(spark, str(tmp_path))).collect()
    assert [(r.name, r.path, r.module) for r in got] == [("U7", "app/U1", "click")]
