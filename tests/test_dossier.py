import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordfold.operators import dossier, overlay
from recordfold.operators.positional import positional_index
from recordfold.operators.textmatch import find_passages
from recordfold.schemas import ANNOTATIONS
from fixtures import tables
from helpers import rows


def _by_patient(spark, latest=None):
    out = dossier.build_dossiers(tables(spark), latest)
    return {r.patient_id: r for r in out.collect()}


def test_nested_record(spark):
    d = _by_patient(spark)
    assert set(d) == {"P1", "P2", "P3"}
    p1 = d["P1"]
    assert (p1.identity.id, p1.identity.sexe, p1.identity.age) == ("P1", "F", 70)  # first row wins
    assert p1.sejourOrder == ["S_NEW", "S_OLD"]
    new = p1.sejours["S_NEW"]
    docs = {x.id: x.highlights for x in new.documents}
    # two suggestions cite d1; the empty passage is skipped
    assert docs == {"d1": ["CARDIOPATHIE ISCHÉMIQUE", "Insuffisance rénale aiguë"], "d2": []}
    f1 = new.fiches[0]
    assert f1.titre == "Liaison" and [c.label for c in f1.champs] == ["Motif", "Douleur", "Mobilité"]
    assert [m.id for m in new.medicaments] == ["S_NEW-med-0", "S_NEW-med-1"]
    assert [c.fc for c in new.constantes] == [88, None]
    assert {s.id: s.status for s in new.suggestions} == {k: "pending" for k in ("sg1", "sg2", "sg3", "sg4")}
    assert [x.id for x in p1.horsSejour.documents] == ["d0"]
    assert p1.horsSejour.documents[0].highlights == []
    assert [x.id for x in p1.horsSejour.fiches] == ["f0"]
    assert d["P3"].sejourOrder == [] and d["P3"].sejours == {}


def test_nested_record_with_decisions(spark):
    t0 = dt.datetime(2025, 1, 3, 9, 0)
    log = spark.createDataFrame([
        (t0, "ana", "P1", "S_NEW", "suggestion", "sg1", "validé", None, None, None, None, 1),
        (t0, "ana", "P1", "S_NEW", "suggestion", "sg2", "modifié", "N17.0", "IRA nécrose", None, None, 2),
        (t0, "ana", "P1", "S_NEW", "code_valide", "cv3", "supprimé", None, None, None, None, 3),
        (t0, "ana", "P1", "S_NEW", "manuel", "m1", "ajouté", "R05", "Toux", "CIM-10", None, 4),
    ], ANNOTATIONS)
    latest = overlay.latest_actions(log).drop("user")
    new = _by_patient(spark, latest)["P1"].sejours["S_NEW"]
    st = {s.id: (s.status, s.code, s.amended) for s in new.suggestions}
    assert st["sg1"] == ("validé", "I25.9", False) and st["sg2"] == ("modifié", "N17.0", True)
    codes = [(c.id, c.removed, c.manuel) for c in new.codesValides]
    assert codes == [("cv3", True, False), ("m1", False, True)]


def test_form_headers(spark):
    t = tables(spark)
    h = dossier.form_headers(t["fiches"])
    assert rows(h, "fiche_id", "titre", "n_champs", "first_label", "last_label") == [
        ("f0", "Ancienne", 1, "Note", "Note"), ("f1", "Liaison", 3, "Motif", "Mobilité")]


def test_positional_index_matches_window(spark):
    rnd = random.Random(7)
    data = [(rnd.choice(["a", "b", None]), rnd.randint(0, 30), rnd.random()) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, t int, v double")
    want = df.withColumn("idx", (F.row_number().over(Window.partitionBy("g").orderBy("t", "v")) - 1)
                         .cast("bigint"))
    got = positional_index(df, ["g"], ["t", "v"], bucket=(F.col("t") / 7).cast("int"))
    assert rows(got) == rows(want)


def test_find_passages_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["lorem", "ipsum", "dolor", "été", "œuvre", "a", "bc", "x1"]
    seps = [" ", ", ", ". ", "\n", " - "]

    def text(n):
        out = []
        for _ in range(n):
            out += [rnd.choice(words), rnd.choice(seps)]
        return "".join(out)

    texts = [(i, text(rnd.randint(0, 30))) for i in range(60)]
    passages = []
    for j in range(40):
        src = texts[rnd.randrange(len(texts))][1]
        if src and j % 4:
            a = rnd.randrange(len(src))
            passages.append((j, src[a:a + rnd.randint(1, 25)]))
        else:
            passages.append((j, text(rnd.randint(1, 3))))
    passages += [(100, ", "), (101, "zz"), (102, "")]
    want = sorted((i, j, t.find(p) + 1) for i, t in texts for j, p in passages if p and p in t)
    tdf = spark.createDataFrame(texts, "tid int, body string")
    pdf = spark.createDataFrame(passages, "pid int, passage string")
    got = find_passages(tdf, ["tid"], "body", pdf, ["pid"], "passage")
    assert sorted(tuple(r) for r in got.select("tid", "pid", "offset").collect()) == want


def test_positional_index_hot_group(spark):
    # one stay holds ~90% of the rows: its buckets are numbered in parallel
    data = [("hot" if i % 10 else "s%d" % (i % 7), i % 97, i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, t int, v int")
    bucket = F.col("t") / 10
    got = positional_index(df, ["g"], ["t", "v"], bucket=bucket.cast("int"))
    want = df.withColumn("idx", (F.row_number().over(Window.partitionBy("g").orderBy("t", "v")) - 1)
                         .cast("bigint"))
    assert rows(got) == rows(want)
    hot_buckets = df.where("g = 'hot'").select(bucket.cast("int")).distinct().count()
    assert hot_buckets == 10


def test_duplicate_stay_rows(spark):
    t = tables(spark)
    extra = spark.createDataFrame([("P2", 5, "S_B", "Rééducation", dt.date(2024, 3, 1), dt.date(2024, 3, 9), 99)],
                                  t["sejours"].schema)
    t["sejours"] = t["sejours"].unionByName(extra)
    p2 = {r.patient_id: r for r in dossier.build_dossiers(t).collect()}["P2"]
    assert p2.sejourOrder == ["S_B", "S_B"]          # the list keeps both rows
    assert p2.sejours["S_B"].service == "Rééducation"  # the last by ordre gives the header


def test_file_position(spark, tmp_path):
    from recordfold.sources.ingest import with_position
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i,) for i in range(50)], "v int").coalesce(1).write.parquet(path)
    got = [(r.v, r.pos["_row"]) for r in with_position(spark.read.parquet(path)).collect()]
    assert got == [(i, i) for i in range(50)]


def test_files_to_nested_record(spark, tmp_path):
    """Write the fixture as files, load them the tolerant way with positions,
    and build the records: same result as from the in-memory tables."""
    from recordfold.sources import ingest
    t = tables(spark)
    base = str(tmp_path)
    ingest.write_tables({n: df.drop("pos").coalesce(1) for n, df in t.items()}, base)
    loaded = {n: ingest.load_table(spark, base, n, position=True) for n in t}
    a = {r.patient_id: r.asDict(recursive=True) for r in dossier.build_dossiers(loaded).collect()}
    b = {r.patient_id: r.asDict(recursive=True) for r in dossier.build_dossiers(t).collect()}
    assert a == b


def test_flattened_records_give_the_tables_back(spark):
    t = tables(spark)
    flat = dossier.flatten_dossiers(dossier.build_dossiers(t))
    assert set(flat) == {"patients", "sejours", *dossier.CHILDREN}
    stays = t["sejours"].select("patient_id", "id_sejour").distinct()
    for name, table, key in (("medicaments", "medicaments", "nom"), ("biologie", "biologie", "code"), ("parcours", "parcours", "event_id")):
        want = t[table].join(stays, ["patient_id", "id_sejour"], "left_semi")
        got = flat[name].withColumnRenamed("id", "event_id") if name == "parcours" else flat[name]
        assert rows(got, "patient_id", "id_sejour", key) == rows(want, "patient_id", "id_sejour", key)
    docs = t["documents"].join(stays, ["patient_id", "id_sejour"], "left_semi").union(
        t["documents"].where("id_sejour IS NULL").join(t["patients"].select("patient_id"), "patient_id", "left_semi").select(*t["documents"].columns))
    assert sorted(r.id for r in flat["documents"].collect()) == sorted(r.doc_id for r in docs.collect())


def test_tokens_are_found_without_their_texts(spark):
    from recordfold.operators.textmatch import passages_in
    texts = ["the abcdefghij klm", "xabcdefghijx, abcdefgh", "été-né 42", "", None]
    found = ["abcdefghi", "abcdefgzz", "efgh", "é", "été", "m", "-", "cdefghij klm", "é-n"]
    tdf = spark.createDataFrame(list(enumerate(texts)), "tid int, body string")
    for some in (found, found[:6]):
        pdf = spark.createDataFrame(list(enumerate(some)), "pid int, passage string")
        got = passages_in(tdf, ["tid"], "body", pdf, ["pid"], "passage")
        assert rows(got, "tid", "pid") == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(some) if t and p in t)
    assert "instr" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_gram_index_grows_with_the_lengths_in_use(spark):
    from recordfold.operators.textmatch import _gram_index
    units = spark.createDataFrame([("abcdefghij",), ("aaaaaaaaaa",), ("abc",)], "_unit string")
    assert rows(_gram_index(units, F.array(F.lit(8))), "_gram") == [("aaaaaaaa",), ("abcdefgh",), ("bcdefghi",), ("cdefghij",)]


def test_line_items_meet_their_orders_once(spark, tmp_path):
    """Doses, lab results and codes are projections of what ``stored`` gives back; ids and
    rows stay as they were with null keys and repeated orders."""
    from recordfold.plans import adapters as ad
    line = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate timestamp_ntz, l_quantity double, l_discount double, l_returnflag string"
    day = dt.datetime(2024, 1, 2)
    frames = {"lineitem": ([(1, 1, 5, 3, 1.0, day, 2.0, 0.1, "R"), (1, None, 6, 4, 1.0, day, 3.0, 0.2, "N"), (None, 1, 7, 5, 1.0, day, 4.0, 0.3, "N")], line),
              "orders": ([(1, 10, day, "1-URGENT"), (1, 10, day, "1-URGENT"), (2, None, day, "2-HIGH")], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string"),
              "customer": ([(10, 1)], "c_custkey bigint, c_nationkey int"), "events": ([], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
              "documents": ([(1, "one text", "fr", "s"), (4, "no order", "fr", "s"), (None, "no id", "fr", "s")], "doc_id bigint, text string, lang string, source string"),
              "pages": ([], "page_id bigint, url string"), "benchmark": ([], "item_id bigint, text string"),
              "conversations": ([], "conv_id bigint, turn bigint, role string, text string")}
    for name, (data, ddl) in frames.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    seen = []
    t = ad.domain_tables(spark, str(tmp_path), lambda df, label: seen.append(label) or df)
    assert sorted(seen) == ["lines", "orders"]
    assert rows(t["codes_valides"], "patient_id", "code_id") == sorted([("10", "1-1-5"), ("10", "1-6")] * 2)
    assert t["medicaments"].count() == 4 and t["biologie"].count() == 8
    assert rows(t["documents"], "patient_id", "doc_id") == sorted([("10", "1"), ("10", "1"), (None, "4"), (None, None)], key=lambda r: tuple((x is None, str(x)) for x in r))


def test_rows_of_all_tables_in_one_pass(spark):
    t = tables(spark)
    records = dossier.build_dossiers(t)
    flat, whole = dossier.flatten_dossiers(records), dossier.flatten_rows(records)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Union" not in plan
    got = whole.collect()
    assert {r.kind for r in got} == set(flat)
    for name, df in flat.items():
        place = {"patients": (), "sejours": ("ordre",)}.get(name, ("pos",))
        own = [c for c in df.columns if c not in ("patient_id", "id_sejour", *place)]
        want = [(r.patient_id, r.id_sejour if "id_sejour" in df.columns else None, *[r[p] for p in place], *[r[c] for c in own]) for r in df.collect()]
        mine = [(r.patient_id, r.id_sejour, *[r.pos for _ in place], *[r[name][c] for c in own]) for r in got if r.kind == name]
        assert sorted(map(repr, mine)) == sorted(map(repr, want))
