import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.engine import Engine, GenerationCache
from ledgerloom.exports import as_json, as_table, as_yaml, display_rows, model_list
from ledgerloom.snapshots import Conflict, GenerationStore, HadoopFiles, checksum
from ledgerloom.sources.listings import TRANSPORTS, register
from ledgerloom.sources.payloads import decode_records, oversized, quarantined, unknown_members
from ledgerloom.sources.workspace import Dirty, materialise, read_workspace, write_yaml


def test_records_are_decoded_one_by_one(spark, rows):
    shape = T.StructType.fromDDL("id string, n bigint")
    data = [(1, '{"data": [{"id": "a", "n": 1}, {"id": "b", "n": "x"}, 5, null, {"id": "c"}]}'), (2, '{"data": {"z": {"id": "y"}, "a": {"id": "x"}}}'), (3, "{"), (4, '{"data": null}'), (5, '{"data": []}'), (6, None)]
    found = decode_records(spark.createDataFrame(data, "k int, p string"), "k", "p", "data", shape, limit=4)
    assert rows(found.accepted) == [(1, 0, None, "a", 1), (2, 0, "a", "x", None), (2, 1, "z", "y", None)]
    assert sorted((r.k, r.place, r.reason) for r in found.rejected.where("place is not null").collect()) == [(1, 1, "schema"), (1, 2, "not an object"), (1, 3, "not an object"), (1, 4, "truncated")]
    assert rows(found.report) == [(1, 1, 4, True, False), (2, 2, 0, False, False), (3, 0, 0, False, True), (4, 0, 0, False, True), (5, 0, 0, False, False), (6, 0, 0, False, True)]


def test_unknown_members_and_guards(spark, rows):
    df = spark.createDataFrame([(1, '{"id": 1, "new": {"b": 1, "a": 2}}'), (2, "x"), (3, "[" * 70 + "]" * 70), (4, '"' + "y" * 100 + '"'), (5, None), (6, '{"[": "\\"]"}')], "k int, p string")
    got = rows(unknown_members(df, "k", "p", ["id"], "top."))
    assert [r[:2] for r in got] == [(1, "top.new"), (6, "top.[")] and len(got[0][2]) == 64
    assert rows(oversized(df, "k", "p", most_bytes=90 + 60)) == [(2, "syntax"), (3, "depth"), (5, "missing")]
    assert rows(oversized(df.where("k = 4"), "k", "p", most_bytes=50)) == [(4, "size")]
    ids = spark.createDataFrame([("a", "n", 1), ("a", "n", 0), (" b", "n", 2), ("c", " ", 3), ("d\u0001", "n", 4), (None, "n", 5)], "id string, name string, place int")
    fine, bad = quarantined(ids, ["id"], F.col("id"), F.col("name"), F.col("place"))
    assert rows(fine) == [("a", "n", 0)] and sorted(r.reason for r in bad.collect()) == ["id: blank", "id: control characters", "id: padded", "name: blank", "repeated"]


def test_workspace(spark, rows, tmp_path):
    (tmp_path / "providers/p/models/org").mkdir(parents=True)
    (tmp_path / "authors/x/models").mkdir(parents=True)
    (tmp_path / "providers.yaml").write_text("- id: p\n  aliases: [pp]\n  name: P\n- name: nameless\n")
    (tmp_path / "authors.yaml").write_text("- id: x\n  name: X\n")
    (tmp_path / "providers/p/models/org/m.yaml").write_text("id: org/m\nname: M\nmetadata:\n  release_date: 2025-08-05\nlimits:\n  context_window: 4096\n")
    (tmp_path / "providers/p/models/bad.yaml").write_text("id: [unclosed\n")
    (tmp_path / "authors/x/models/m.yaml").write_text("id: m\n")
    (tmp_path / "providers/p/logo.svg").write_text("<svg/>")
    found = read_workspace(spark, str(tmp_path))
    assert rows(found.providers.select("id", "aliases")) == [("p", ["pp"])] and rows(found.authors.select("id")) == [("x",)]
    assert rows(found.provider_models.select("provider_id", "id", "metadata.release_date", "limits.context_window")) == [("p", "org/m", "2025-08-05", 4096)]
    assert rows(found.author_models.select("author_id", "id")) == [("x", "m")] and rows(found.logos.select("kind", "id")) == [("providers", "p")]
    assert sorted(r.problem.split("\n")[0][:5] for r in found.rejected.collect())[-1] == "while" and found.rejected.count() == 2
    assert read_workspace(spark, str(tmp_path), most_models=1).rejected.where("problem = 'truncated'").count() == 1
    assert write_yaml(found.provider_models.select("id", "name"), str(tmp_path / "out"), "id") == 1 and (tmp_path / "out/org/m.yaml").read_text() == "id: org/m\nname: M\n"


def test_listing_source(spark, rows, tmp_path):
    for name, pages in {"good": {"first": {"models": [{"id": 1}], "nextPageToken": "t"}, "t": {"models": [{"id": 2}]}}, "loop": {"first": {"models": [], "nextPageToken": "t"}, "t": {"models": [], "nextPageToken": "t"}}, "plain": {"first": {"data": [{"id": 3}]}}}.items():
        (tmp_path / name).mkdir()
        for token, page in pages.items():
            (tmp_path / name / f"{token}.json").write_text(json.dumps(page))
    register(spark)
    got = spark.read.format("catalog_listing").option("providers", "good:google,loop:google,plain:openai,absent:openai").load(str(tmp_path)).collect()
    assert sorted((r.provider_id, r.page, r.record) for r in got if r.problem is None) == [("good", 0, '{"id": 1}'), ("good", 1, '{"id": 2}'), ("plain", 0, '{"id": 3}')]
    assert {r.provider_id for r in got if r.problem} == {"loop", "absent"} and "files" in TRANSPORTS


def test_generations(spark, rows, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "store"))
    one, two = spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"), spark.createDataFrame([(2, None)], "k int, v string")
    assert store.current_id() is None and checksum(one)[1] == 2
    store.commit("g1", "2026-01-01T00:00:00+00:00", {"m": one}, None)
    store.commit("g1", "2026-01-01T00:00:00+00:00", {"m": one.repartition(3)}, "ignored, since nothing changes")
    with pytest.raises(Conflict):
        store.commit("g1", "x", {"m": two}, "g1")
    with pytest.raises(Conflict):
        store.commit("g2", "x", {"m": two}, None)
    store.commit("g2", "2026-01-02T00:00:00+00:00", {"m": two}, "g1")
    assert store.generations() == ["g1", "g2"] and rows(store.read("m")) == [(2, None)] and rows(store.read("m", "g1")) == [(1, "a"), (1, "a")]
    assert store.read_if_changed("m", "g2") is None and store.read_if_changed("m", "g1") is not None and store.verify("g2") == []
    assert store.activate("g1") and not store.activate("g1") and store.current_id() == "g1"
    with pytest.raises(KeyError):
        store.read("m", "g9")
    with pytest.raises(ValueError, match="invalid"):
        store.commit("../x", "x", {}, None)


def test_generations_on_any_file_system(spark, rows, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "store"))
    store.files = HadoopFiles(spark, f"file://{tmp_path}/store")
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    store.commit("g1", "2026-01-01T00:00:00+00:00", {"m": one}, None)
    store.commit("g2", "2026-01-02T00:00:00+00:00", {"m": two}, "g1")
    assert store.generations() == ["g1", "g2"] and store.current_id() == "g2" and rows(store.read("m", "g1")) == [(1, "a")] and store.verify("g1") == []
    assert not store.files.create("pointers/" + "0" * 19 + "2", "g9") and store.files.read("nothing") is None and store.files.names("nowhere") == []
    with pytest.raises(Conflict):
        store.commit("g3", "x", {"m": two}, "g1")


def test_of_two_writers_one_wins_and_crashes_leave_nothing_held(spark, rows, tmp_path):
    store = GenerationStore(spark, str(tmp_path))
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    store.commit("g1", "t", {"m": one}, None)
    number, _ = store._pointer()
    store.commit("g2", "t", {"m": two}, "g1")
    with pytest.raises(Conflict):
        store._advance(number, "g3")  # a writer that had read the same pointer
    (tmp_path / "generations" / "half" / "attempt").mkdir(parents=True)  # what a crash before the manifest leaves
    assert store.generations() == ["g1", "g2"] and store.current_id() == "g2" and rows(store.read("m")) == [(2,)]
    store.commit("half", "t", {"m": one}, "g2")
    assert rows(store.read("m")) == [(1,)]
    with pytest.raises(ValueError, match="refused"):
        Engine(store, verify=lambda manifest, _: "unsigned").activate(store.manifest("g1"), {"m": one})


def test_checksums(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    same = base.select("v", "k").orderBy(F.desc("k"))
    assert checksum(base) == checksum(same)
    others = [base.limit(1), base.unionAll(base), base.withColumn("v", F.coalesce("v", F.lit(""))), base.withColumn("k", F.col("k").cast("bigint")), base.limit(0)]
    assert len({checksum(x)[0] for x in (base, *others)}) == 6


def test_engine(spark, rows, tmp_path):
    seed = {"m": spark.createDataFrame([(1, "a")], "k int, v string")}
    engine = Engine(GenerationStore(spark, str(tmp_path)), seed)
    told, changed = [], []
    engine.on_published(told.append)
    engine.on_changes("m", ("k",), lambda df: changed.append(rows(df.select("k", "change_type"))))
    done = engine.update("g2", lambda c: {"m": c["m"].unionAll(spark.createDataFrame([(2, "b")], "k int, v string"))})
    assert done.published and done.sequence == 2 and rows(engine.catalog()["m"]) == [(1, "a"), (2, "b")] and changed == [[(2, "added")]]
    assert engine.rollback("seed").published and rows(engine.catalog()["m"]) == [(1, "a")] and not engine.rollback("seed").published
    assert [p.generation_id for p in told] == ["g2", "seed"] and engine.readiness(least_rows={"m": 5}) == ["few m"]
    import dataclasses

    old = dataclasses.replace(engine.store.manifest("g2"), generation_id="g0", generated_at="2000-01-01T00:00:00+00:00")
    assert not engine.activate(old, seed).published and engine.store.current_id() == "seed"


def test_exports(spark, rows):
    df = spark.createDataFrame([("b", dt.datetime(2024, 1, 1), ["x", "y"], 128_000, "long " * 40), ("a", None, None, 0, " ")], "id string, at timestamp_ntz, owners array<string>, ctx int, text string")
    listed = model_list(df, F.col("id"), F.col("at"), F.col("owners"))
    assert rows(listed) == [("a", "model", 0, "system"), ("b", "model", 1704067200, "x,y")]
    assert json.loads(as_json(listed, [F.col("id")]))[0] == {"created": 0, "id": "a", "object": "model", "owned_by": "system"}
    assert as_yaml(listed.limit(0), [F.col("id")]) == "[]\n"
    shown = display_rows(df, F.col("id"), F.col("id"), F.col("ctx"), F.col("text"))
    assert rows(shown)[0] == ("a", "a", "-", "-") and rows(shown)[1][2] == "128.0K" and len(rows(shown)[1][3]) == 80
    assert as_table(listed.orderBy("id")).splitlines()[1].split() == ["a", "model", "0", "system"]


def test_materialised_workspace(spark, rows, tmp_path):
    root = str(tmp_path / "w")
    for kind in ("providers", "authors"):
        (tmp_path / "w" / kind).mkdir(parents=True)
    read = lambda r: {"authors": read_workspace(spark, f"file://{r}").authors.select("id", "name")}
    frame = lambda *names: {"authors": spark.createDataFrame([(n, n.upper()) for n in names], "id string, name string"), "providers": spark.createDataFrame([("p", "P")], "id string, name string")}
    assert materialise(frame("a", "b"), root, "g1", read=read) and not materialise(frame("a", "b"), root, "g1", read=read)
    assert materialise(frame("a", "c"), root, "g2", read=read) and rows(read(root)["authors"]) == [("a", "A"), ("c", "C")]
    old = (tmp_path / "w" / "authors.yaml").read_text()
    assert materialise(frame("d"), root, "g3", read=read)
    (tmp_path / "w" / "authors.yaml").write_text(old)  # as a crash between the state and the file leaves it
    assert materialise(frame("d"), root, "g3", read=read) and rows(read(root)["authors"]) == [("d", "D")]
    (tmp_path / "w" / "authors.yaml").write_text("- id: mine\n  name: Mine\n")
    with pytest.raises(Dirty):
        materialise(frame("e"), root, "g4", read=read)
    assert rows(read(root)["authors"]) == [("mine", "Mine")]


def test_cache_by_generation():
    now = [0.0]
    cache = GenerationCache(10.0, lambda: now[0])
    assert cache.advance(1, "g1") and not cache.advance(1, "g0")
    cache.put(1, "g1", "k", "v")
    cache.put(9, "g9", "k", "other")
    assert cache.get(1, "g1", "k") == "v" and cache.get(1, "g2", "k") is None and cache.get(1, "g1", "q") is None
    now[0] = 10.0
    assert cache.get(1, "g1", "k") is None
    cache.put(1, "g1", "k", "v")
    assert cache.advance(2, "g2") and cache.get(1, "g1", "k") is None and cache.get(2, "g2", "k") is None
