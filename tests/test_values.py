"""Golden values of the normalising functions, pages and sources."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tendril.functions import distance as edit
from tendril.functions import text as T
from tendril.operators import documents, forest, indicators, minutes, relational, risk
from tendril.session import delete, scope, scratch_path, stored
from tendril.sources import binary, html, jsonl, kernels, portal, store, web
from tendril.streaming import ingest


def mapped(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


# fixed values: inputs and outputs that must equal the published rules
GOLDEN = [
    (T.parse_amount, [("15 000 000,00 @@@@", 15000000.0), ("133 075 758,00", 133075758.0), ("0,00 MAD", 0.0), ("758 640,00 DH TTC", 758640.0), ("15.000.000", 15000000.0), ("-", None), ("", None), (None, None), ("1.234.567,89", 1234567.89), ("1,234.56", 1234.56), ("1,234,567", 1234567.0), ("15.000", 15.0), ("120.000,00", 120000.0), ("2 337 480.00", 2337480.0), ("12-34", None), ("5,00 Dhs.", 500.0)]),
    (T.parse_date, [("04/11/2026 11:00", dt.date(2026, 11, 4)), ("12/08/2026", dt.date(2026, 8, 12)), ("32/01/2026", None), ("pas de date", None), (None, None)]),
    (T.tri_state, [("Oui", True), ("non", False), ("-", None), ("", None), (None, None)]),
    (T.normalize_reference, [(" aon31/2024/so2300up ", "AON31/2024/SO2300UP"), ("22 / 2026 / DAAC", "22/2026/DAAC"), (None, None)]),
    (T.clean_value, [("néant", None), (" - ", None), ("a\u00a0\u2003b", "a b"), ("*x*", "x"), ("@@@@", None)]),
    (T.label_field, [("Date limite", "date_limite_remise_plis"), ("Lieu d'exécution", "lieu_execution"), ("Lieu d’exécution", None), ("Visites", None)]),
    (T.corrupted, [("", False), ("ROYAI]ME DU i\\{AROC", True), ("Royaume du Maroc, appel d'offres", False), ("mot " * 30, False), ("m0t4 x9x9 " * 15, True), (None, False)]),
    (T.award_status, [("déclaré infructueux", "INFRUCTUEUX"), ("concurrent retenu : X", "ATTRIBUE"), ("", None)]),
    (T.strip_arabic, [("MAROC المملكة x", "MAROC x")]),
    (T.normalize_company, [("Société ALPHA  SARL AU", "ALPHA"), ("sté", "STÉ"), (None, None)]),
    (T.result_count, [("Nombre de résultats : 1\u00a0234 ", 1234), ("rien", None)]),
]


@pytest.mark.parametrize("fn,cases", GOLDEN, ids=lambda v: getattr(v, "__name__", ""))
def test_golden(spark, fn, cases):
    assert mapped(spark, fn, [a for a, _ in cases]) == [b for _, b in cases]


def one_page(spark, text):
    return spark.createDataFrame([(1, text)], "page_id int, html string")


DETAIL = """<h1>Consultation</h1><div class="line">Référence 17/DR/2025</div>
<div class="panel line"><label>Date et heure limite de remise des plis</label> : 21/05/2025 <i>10:30</i></div>
<div class="line">Procédure : Concours | Enveloppe unique</div><div class="line">Estimation (en Dhs TTC) * : 2 450 300,50 @@@@</div>
<div class="line">Réservé à la TPE et PME * : Oui</div><div class="line">Domaines d'activité :</div><div class="line">Domaines d'activité : Bois</div>
<div class="line">Domaines d'activité : Fer</div><div class="line">Qualifications : néant</div><div class="line">Allotissement : -</div>
<div class="line">Réunion d'information : salle B</div><div class="line">Réunion d'information : salle C</div><div class="line">Lieu d'exécution : AZROU</div>
<div class="line">Lieu d'ouverture des plis : siège d'Azrou</div><a href="?page=EntrepriseDemandeTelechargementDce&id=5">DCE</a>"""
LISTING = """<table><tr><td>AOO Fournitures 02/03/2025</td><td>17/DR/2025 - Mobilier scolaire</td><td>21/05/2025</td><td><a href="?page=entreprise.EntrepriseDetailConsultation&refConsultation=501&orgAcronyme=az">Voir</a></td></tr>
<tr><td>Sans date</td><td><a href="?page=entreprise.EntrepriseDetailConsultation&refConsultation=501&orgAcronyme=az">encore</a></td></tr>
<tr><td>Travaux</td><td>B-9 -pont</td><td>30/02/2025 puis 04/03/2025</td><td><a href="/index.php?x=EntrepriseDetailConsultation&refConsultation=502&orgAcronyme=kx">Voir</a></td></tr></table>
<a href="?page=entreprise.EntrepriseDetailConsultation&refConsultation=503&orgAcronyme=q">hors tableau</a>"""


def test_detail_page(spark):
    r = html.detail_records(one_page(spark, DETAIL), "page_id", "html").first()
    assert r.reference == "17/DR/2025" and r.mode_passation == "Concours" and r.estimation_dhs_ttc == 2450300.5
    assert r.allotissement is None and r.qualifications is None and r.reserve_tpe_pme is True
    assert r.domaines_activite == "Bois" and r.date_limite_remise_plis == dt.date(2025, 5, 21)
    assert r.lieu_execution == "AZROU" and r.lieu_ouverture_plis == "siège d'Azrou" and r.date_mise_ligne is None
    assert r.is_publicly_downloadable is False and r.dossier_consultation_url.endswith("EntrepriseDemandeTelechargementDce&id=5")
    assert r.extras == {"Réunion d'information": "salle B"}


def test_empty_page(spark):
    r = html.detail_records(one_page(spark, "<html></html>"), "page_id", "html").first().asDict()
    assert r.pop("page_id") == 1 and r.pop("extras") == {} and set(r.values()) == {None}


def test_listing(spark):
    rows = html.listing_rows(one_page(spark, LISTING), "page_id", "html").orderBy("pos").collect()
    assert [(r.refConsultation, r.orgAcronyme, r.reference, r.date_mise_ligne, r.date_limite_remise_plis) for r in rows] == [
        ("501", "az", "17/DR/2025", dt.date(2025, 3, 2), dt.date(2025, 5, 21)),
        ("502", "kx", None, None, dt.date(2025, 3, 4)),
    ]
    found = html.listing_rows(one_page(spark, LISTING), "page_id", "html", minutes=True).orderBy("pos").collect()
    assert [(r.refConsultation, r.reference, r.date_publication) for r in found] == [("501", "17/DR/2025", dt.date(2025, 3, 2)), ("502", "B-9", None)]
    kinds = html.inventory(one_page(spark, LISTING), "page_id", "html").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in kinds} == {"link": 4, "date": 4, "row": 3}


def test_pages_are_parsed_once(spark):
    for fn in (html.listing_rows, html.detail_records):
        plan = fn(one_page(spark, DETAIL), "page_id", "html")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_plain_markup_reads_as_the_parser_does(monkeypatch):
    draw = random.Random(11)
    bits = ["<tr>", "<td>", "</td>", "</tr>", "<TABLE>", "</table>", '<div class="a line">', "</div>", '<a href="?x&amp;y=1">', "</a>", "<br>", "<b >", "</b\n>", " mot ", "&eacute;t&eacute;", "a &amp; b", "&amp", "x > y", "\n", '<a title="t" HREF="q">', '<td class="c" >', "</p>"]
    odd = ["<br/>", "<!-- c -->", "<a href='z'>", "1 < 2", "<script><td></script>", '<a href="?r&eacute;f">', "<td class=x>", "</td x>", "<", "<title><b></title>", '<a href="1"href="2">']

    def plain(page):
        parser = html.Pieces()
        parser.feed(page)
        parser.close()
        return parser.links, parser.lines, parser.rows

    for k in range(3000):
        page = "".join(draw.choice(bits + odd * (k % 3 == 0)) for _ in range(draw.randint(0, 25)))
        got = html.parsed(page)
        assert (got.links, got.lines, got.rows) == plain(page), page
    monkeypatch.setattr(html.HTMLParser, "goahead", lambda *_: 1 / 0)  # plain pages need no parser
    assert html.parsed('<div class="line">R&eacute;f : 1</div><table><tr><td>a</td></tr></table>').lines == [{"pos": 0, "text": "Réf : 1"}]


def test_each_step_of_an_amount_is_computed_once(spark):
    plan = html.detail_records(one_page(spark, DETAIL), "page_id", "html")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^0-9,.") == 1


def test_pages_of_orders_are_dealt_to_all_tasks(spark, sf):
    from tendril.plans import inline

    assert inline.listing_rows(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_form_state():
    page = '<form action="/go"><input name="a" value="1"><input type="checkbox" name="b"><input type="checkbox" name="c" checked><input type="submit" name="s"><select name="d"><option value="x"><option value="y" selected></select><select name="e"><option value="q"></select></form>'
    assert html.form_state(page, "http://h/p") == ({"a": "1", "c": "on", "d": "y", "e": "q"}, "http://h/go")
    with pytest.raises(ValueError):
        html.form_state("<p>", "http://h")


def test_document_status(spark):
    rows = [("n", "native", None, None, None), ("f", "ocr", None, 0, "x"), ("l", "ocr", 90.0, 2, None), ("s", "ocr", 60.0, 5, None), ("b", "ocr", 59.9, 5, None), ("m", "ocr", 88.0, 9, None), ("m", "ocr", 0.0, 1, None), ("m", "native", None, None, None)]
    got = {r.doc: (r.ocr_status, r.mean_confidence) for r in documents.document_status(spark.createDataFrame(rows, "doc string, source string, confidence double, word_count int, error string")).collect()}
    assert got == {"n": ("native", None), "f": ("ocr_failed", None), "l": ("ocr_low_confidence", 0.0), "s": ("ocr_success", 60.0), "b": ("ocr_low_confidence", 59.9), "m": ("ocr_success", 88.0)}


def test_manifest(spark, tmp_path):
    url = "http://h/?page=x&refConsultation={}&orgAcronyme=o"
    lines = [json.dumps({"reference": "a", "pdf_url": url.format(1), "file_hash": "h", "scraped_at": "2"}), json.dumps({"reference": "b", "pdf_url": url.format(1), "file_hash": "h", "scraped_at": "1"}), "", "{broken", json.dumps({"reference": "c", "pdf_url": "http://h"})]
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join(lines))
    first, counts = jsonl.manifest_index(jsonl.scan(spark, str(path)).cache())
    assert [(r.refConsultation, r.reference) for r in first.collect()] == [("1", "b")]
    assert counts.first()[:2] == (2, 2)
    assert jsonl.scan(spark, str(path), mode="silent").collect().__len__() == 3
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        jsonl.scan(spark, str(path), mode="strict").collect()
    state = tmp_path / "state.json"
    state.write_text(json.dumps({"1": {"page": 3, "per_year": {"2024": 5}, "seen": ["7"]}}))
    assert jsonl.checkpoint_state(spark, str(state)).first()[:2] == ("1", 3)
    state.write_text("not json")
    assert jsonl.checkpoint_state(spark, str(state)).count() == 0
    out = str(tmp_path / "out")
    jsonl.append(spark.createDataFrame([("r", "x", "z")], "objet string, other string, reference string"), out)
    assert list(json.loads(spark.read.text(out).first()[0])) == ["reference", "objet", "other"]


def test_binary_files(spark, tmp_path):
    for name, body in (("b.pdf", b"%PDF-1 x"), ("a.pdf", b"%PDF-1 x"), (f"{binary.EXCLUDED_STEMS[0]}.pdf", b"y"), ("c.txt", b"z")):
        (tmp_path / name).write_bytes(body)
    got = binary.scan(spark, [str(tmp_path)])
    assert sorted(r.stem for r in got.collect()) == ["a", "b"] and got.select("file_hash").distinct().count() == 1
    assert [r.stem for r in binary.scan(spark, [str(tmp_path)], limit=1).collect()] == ["a"]
    years = spark.createDataFrame([(2024, got.first().file_hash), (2025, "none")], "year int, file_hash string")
    assert [tuple(r) for r in binary.size_by_year(years, got).collect()] == [(2024, 2, 16 / 1e6)]
    assert mapped(spark, binary.stem, ["C:\\x\\y.pdf", "/a/b.c.pdf", "none"]) == ["y", "b.c", None]


def test_early_stop_and_quota(spark):
    pages = spark.createDataFrame([("a", 0, 9), ("a", 1, 2), ("a", 2, 9), ("b", 0, 9)], "cat string, page int, newest int")
    assert {tuple(r)[:2] for r in relational.early_stop(pages, ["cat"], "page", "newest", F.lit(5)).collect()} == {("a", 0), ("b", 0)}
    assert relational.quota(pages, ["cat"], [F.col("page")], 2).count() == 3 and relational.quota(pages, ["cat"], [F.col("page")], 0).count() == 4
    rows = spark.createDataFrame([(None, 1), (None, 2), ("k", 3), ("k", 4)], "k string, v int")
    assert sorted(r.v for r in relational.first_wins(rows, ["k"], [F.col("v")]).collect()) == [1, 2, 3]


def test_quota_limits_before_the_shuffle(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = relational.quota(orders, ["o_orderpriority"], [F.col("o_orderkey")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_only_what_is_used(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey as market", "l_suppkey as bidder")
    plan = indicators.bidder_counts(lines)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan


def test_growth_needs_the_year_before(spark):
    rows = spark.createDataFrame([("a", 2020, 2.0), ("a", 2021, 4.0), ("a", 2023, 8.0), ("b", 2020, 0.0), ("b", 2021, 1.0)], "c string, y int, v double")
    got = {(r.c, r.y): r.growth for r in indicators.yoy_growth(rows, "c", "y", "v").collect()}
    assert got == {("a", 2020): None, ("a", 2021): 2.0, ("a", 2023): None, ("b", 2020): None, ("b", 2021): None}


def test_forest_equals_a_plain_walk(spark):
    import random as r

    draw = r.Random(4)
    rows = [(i, draw.gauss(0, 1), float(draw.randint(0, 3)), None if i % 9 == 0 else draw.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(3)
    learnt = forest.samples(df.fillna(0.0), "k", ["a", "b", "c"], 12, 64, 7)
    hashes = {(x.k, x.t): x.h for x in df.select("k", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t")).select("k", "t", F.xxhash64("k", F.lit(7), "t").alias("h")).collect()}
    for tree in range(12):  # the 64 rows of least hash under the tree's seed
        least = sorted(rows, key=lambda x: (hashes[x[0], tree], x[0]))[:64]
        assert learnt[tree].tolist() == [[v or 0.0 for v in x[1:]] for x in least]

    def walk(tree, x):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if x[tree.feature[node]] < tree.cut[node] else tree.right[node]
        return tree.value[node]

    trees = [forest.Tree.grown(learnt[k], r.Random(7 * 1_000_003 + k)) for k in range(12)]
    want = {x[0]: 2 ** (-sum(walk(t, [v or 0.0 for v in x[1:]]) for t in trees) / 12 / forest.path_constant(64)) for x in rows}
    got = {x.k: x.anomaly_score for x in forest.isolation_scores(df, "k", ["a", "b", "c"], trees=12, sample=64).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_forest_leaves_hold_all_rows():
    import random as r

    import numpy as np

    x = np.array([[float(i % 7), float(i % 5)] for i in range(200)])
    tree = forest.Tree.grown(x, r.Random(1))
    depths = tree.depths(x)
    assert (depths >= 1).all() and depths.max() <= 8 + forest.path_constant(200) and len(tree.feature) < 2 * 200
    assert forest.Tree.grown(x[:1], r.Random(1)).depths(x).tolist() == [0.0] * 200
    assert forest.Tree.grown(np.ones((9, 2)), r.Random(1)).depths(x)[0] == forest.path_constant(9)


def test_forest_finds_the_outlier(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(200)] + [(999, 60.0, 60.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    scores = forest.isolation_scores(df, "k", ["a", "b"], sample=201, trees=10)
    assert scores.orderBy(F.desc("anomaly_score")).first().k == 999
    assert [tuple(r) for r in forest.isolation_scores(df.repartition(5), "k", ["a", "b"], sample=201, trees=10).orderBy("k").collect()] == [tuple(r) for r in scores.orderBy("k").collect()]
    assert forest.isolation_scores(df.limit(1), "k", ["a", "b"]).first().anomaly_score == 0.5


def test_stream_resumes(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    write = lambda rows: spark.createDataFrame(rows, "k long, v string").write.mode("append").parquet(source)
    write([(1, "a"), (2, "b"), (1, "a")])
    schema = spark.read.parquet(source).schema
    ingest.ingest(spark, source, root, ["k"], schema).awaitTermination()
    write([(2, "again"), (3, "c")])
    ingest.ingest(spark, source, root, ["k"], schema).awaitTermination()
    ingest.ingest(spark, source, root, ["k"], schema).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{root}/table").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_windowed_counts(spark, sf):
    assert ingest.windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def fake_fetch(category, page, state):
    return (None, None) if page == 3 else (f"{category}/{page}/{state}", page)


def test_portal_source(spark):
    reader = portal.PortalReader({"fetch": f"{__name__}:fake_fetch", "seconds": "0", "maxpages": "5"})
    assert [p.name for p in reader.partitions()] == ["1", "2", "3"] and not list(portal.PortalReader({"fetch": f"{__name__}:fake_fetch", "maxpages": "-1"}).read(portal.Category("1")))
    assert list(reader.read(portal.Category("2"))) == [("2", 0, "2/0/None"), ("2", 1, "2/1/0"), ("2", 2, "2/2/1")]
    assert len(list(portal.PortalReader({"fetch": f"{__name__}:fake_fetch", "maxpages": "2"}).read(portal.Category("2")))) == 2
    tried, waits = [], []
    with pytest.raises(OSError):
        web.patient(lambda: tried.append(1) or (_ for _ in ()).throw(OSError()), sleep=waits.append)
    assert len(tried) == 3 and waits == [2.0, 4.0]
    spark.dataSource.register(portal.Portal)
    assert spark.read.format("tender_portal").load().columns == ["category", "page", "html"]


FORM = """<form action="/search"><input type="hidden" name="STATE" value="s{n}">{size}<input type="submit" name="go"></form>Nombre de résultats : 1 234 {link}"""


@pytest.fixture
def site():
    """A small portal: a form, a page that fails twice, one that always fails."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs

    log: list = []

    class Handler(BaseHTTPRequestHandler):
        def reply(self, body, code=200):
            self.send_response(code)
            self.send_header("X-Kind", "test")
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self):
            log.append(("GET", self.path, self.headers["User-Agent"]))
            tries = sum(x[:2] == ("GET", self.path) for x in log)
            if self.path == "/down" or (self.path == "/shaky" and tries < 3):
                return self.reply("no", 503)
            self.reply(FORM.format(n=0, size="", link=""))

        def do_POST(self):
            form = {k: v[0] for k, v in parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode(), keep_blank_values=True).items()}
            log.append(("POST", self.path, form))
            self.reply(FORM.format(n=form["STATE"][1:], size="", link=""))

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", log
    server.shutdown()


def test_client(site):
    root, log = site
    waits: list[float] = []
    client = web.Client(pause=50.0, sleep=waits.append)
    got = client.get(f"{root}/shaky")
    assert "résultats" in got.text and got.headers["x-kind"] == "test" and waits == [2.0, 4.0]  # one turn, two failures
    assert log[0][2] == web.AGENT
    with pytest.raises(OSError):
        client.get(f"{root}/down", tries=2)
    waits.clear()
    client.post(f"{root}/search", {"STATE": "s0", "é": "à b"})
    assert len(waits) == 1 and 40 < waits[0] <= 50 and log[-1][2]["é"] == "à b"  # a post waits its turn
    waits.clear()
    with pytest.raises(OSError):
        client.post("http://127.0.0.1:1/", {}, tries=3, timeout=1)
    assert [w for w in waits if w in (2.0, 4.0)] == [2.0, 4.0] and len(waits) == 5  # each try waits its turn
    assert web.page_url("a.B", ["AllAnn", "x=1"], q="é b") == web.SITE_INDEX + "?page=a.B&q=%C3%A9+b&AllAnn&x=1"
    assert web.page_url("a") == web.SITE_INDEX + "?page=a"


def test_kernels_isolate_bad_files(spark):
    files = spark.createDataFrame([("a.pdf", b"junk")], "path string, content binary")
    rows = kernels.read_pages(files).collect()
    assert [(r.page_number, r.error is not None) for r in rows] == [(0, True)] and isinstance(kernels.available(), bool)
    assert [tuple(r) for r in kernels.page_counts(files).collect()] == [("a.pdf", None)]


class FakePage:
    def __init__(self, text, width=600, height=800):
        from types import SimpleNamespace

        self.text, self.rect, self.asked = text, SimpleNamespace(width=width, height=height), []

    def get_text(self):
        if self.text is None:
            raise RuntimeError("broken text layer")
        return self.text

    def get_pixmap(self, dpi):
        from types import SimpleNamespace

        self.asked.append(dpi)
        return SimpleNamespace(samples=bytes(range(12)) * 2, height=2, width=4, n=3)


class FakeDocument(list):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


@pytest.fixture
def fakes(monkeypatch):
    """Stand-ins for the native libraries, whose orientation answer is set by the test."""
    import sys
    from types import SimpleNamespace

    import numpy as np

    class TesseractError(Exception):
        pass

    state = SimpleNamespace(pages=[], osd={"rotate": 0, "orientation_conf": 0.0}, lines=None, turned=[])

    def osd(*_, **__):
        if state.osd is None:
            raise TesseractError("too few characters")
        return state.osd

    cv2 = SimpleNamespace(COLOR_RGB2GRAY=0, BORDER_REPLICATE=0, INTER_CUBIC=2, THRESH_BINARY=0, THRESH_OTSU=0, cvtColor=lambda x, _: x[:, :, 0], Canny=lambda x, *_: x, HoughLinesP=lambda *_, **__: state.lines, getRotationMatrix2D=lambda *a: a, warpAffine=lambda g, m, *_, **__: state.turned.append(m[1]) or g, fastNlMeansDenoising=lambda g, h: g, threshold=lambda g, *_: (0, g))
    tess = SimpleNamespace(TesseractError=TesseractError, Output=SimpleNamespace(DICT="d"), image_to_osd=osd, image_to_data=lambda *_, **__: {"conf": ["-1", 90, "80", ""]}, image_to_string=lambda image, **_: f"read {image.shape[0]}x{image.shape[1]}")
    for name, module in (("cv2", cv2), ("pytesseract", tess), ("fitz", SimpleNamespace(open=lambda **_: FakeDocument(state.pages)))):
        monkeypatch.setitem(sys.modules, name, module)
    state.np = np
    return state


def ocr(fakes):
    """Rows of the pages whose own text cannot be used."""
    own = list(kernels.own_texts("p", b""))
    return list(kernels.scans("p", b"", {n for _, n, text, error in own if error is None and len(text) <= 20 or "ROYAI]ME" in (text or "")}, "fra", 3, 300, 4000))


def test_kernel_pages(fakes):
    healthy, broken = "Royaume du Maroc, appel d'offres ouvert", "ROYAI]ME DU i\\{AROC [[]] {{ xx yy }}"
    fakes.pages = [FakePage(f"  {healthy}\n"), FakePage(broken), FakePage(None), FakePage(" " * 50 + "court")]
    rows = ocr(fakes)
    assert [(r[1], r[2], r[10] is None) for r in rows] == [(2, "ocr", True), (4, "ocr", True)]
    own = list(kernels.own_texts("p", b""))
    assert own[0][2] == healthy and rows[0][3:6] == ("read 2x4", 85.0, 2) and "broken text layer" in own[2][3] and kernels.count_of(b"") == 4
    assert fakes.pages[1].asked == [300]


@pytest.mark.parametrize("osd,shape,degrees", [(None, "2x4", 0), ({"rotate": 90, "orientation_conf": 5.0}, "4x2", 90), ({"rotate": 270, "orientation_conf": 0.5}, "2x4", 0), ({"rotate": 45, "orientation_conf": 9.0}, "2x4", 45), ({"rotate": 180, "orientation_conf": 1.0}, "2x4", 180)])
def test_kernel_orientation(fakes, osd, shape, degrees):
    fakes.pages, fakes.osd = [FakePage("")], osd
    row = ocr(fakes)[0]
    assert row[3] == f"read {shape}" and row[8] == degrees and row[10] is None


def test_kernel_skew_and_resolution(fakes):
    page = FakePage("", width=7200, height=100)
    fakes.pages, fakes.lines = [page], fakes.np.array([[[0, 0, 100, 3]], [[0, 0, 100, 3]], [[0, 0, 0, 100]]])
    row = ocr(fakes)[0]
    assert page.asked == [40] and row[7] is True and abs(row[6] - 1.718) < 0.01 and len(fakes.turned) == 1
    fakes.lines = None
    assert ocr(fakes)[0][6:8] == (0.0, False)


def test_ocr_results_and_sink(spark, tmp_path):
    rows = [("/in/a.pdf", 2, "ocr", "zwei", 70.0, 5, 0.1, False, 0, 0.0, None), ("/in/a.pdf", 1, "native", "eins", None, None, None, None, 0, None, None), ("/in/b.pdf", 0, "ocr", "", None, 0, None, None, 0, None, "broken")]
    got = documents.results(spark.createDataFrame(rows, kernels.PAGES))
    assert {(r.path, r.ocr_status, r.mean_confidence, r.text, len(r.pages)) for r in got.collect()} == {("/in/a.pdf", "ocr_success", 70.0, "eins\n\nzwei", 2), ("/in/b.pdf", "ocr_failed", None, "", 1)}
    jsonl.write_ocr(got, str(tmp_path / "ocr"))
    assert sorted(p.name for p in (tmp_path / "ocr").iterdir() if p.suffix != ".crc") in (["_work", "a.json", "a.txt", "b.json", "b.txt"], ["a.json", "a.txt", "b.json", "b.txt"])
    assert (tmp_path / "ocr" / "a.txt").read_text() == "eins\n\nzwei"
    meta = json.loads((tmp_path / "ocr" / "a.json").read_text())
    assert list(meta) == ["pdf_path", "ocr_status", "mean_confidence", "pages"] and [p["page_number"] for p in meta["pages"]] == [1, 2] and meta["pages"][0]["error"] is None
    back = jsonl.ocr_pages(spark, str(tmp_path / "ocr" / "*.json"))
    assert {(r.pdf_path, r.page_number) for r in back.collect()} == {("/in/a.pdf", 1), ("/in/a.pdf", 2), ("/in/b.pdf", 0)}
    seconds = spark.createDataFrame([(2.0,), (4.0,)], "s double")
    assert tuple(documents.run_time(seconds, "s").first()) == (6.0, 2, 3.0) and tuple(documents.run_time(seconds.limit(0), "s").first()) == (0.0, 0, 0.0)


def test_rewrite_and_checkpoint(spark, tmp_path):
    path = str(tmp_path / "manifest")
    spark.createDataFrame([("u1", None), ("u2", "kept"), ("u3", None)], "pdf_url string, categorie_principale string").write.option("ignoreNullFields", "false").json(path)
    read = lambda: spark.read.schema("pdf_url string, categorie_principale string").json(path)
    assert {r.pdf_url for r in jsonl.todo(read()).collect()} == {"u1", "u3"}
    details = spark.createDataFrame([("u1", "Travaux"), ("u2", "other")], "pdf_url string, categorie_principale string")
    for _ in range(2):
        jsonl.rewrite(jsonl.enrich(read(), details, ["categorie_principale"]), path)
    assert {tuple(r) for r in read().collect()} == {("u1", "Travaux"), ("u2", "kept"), ("u3", None)}
    assert not list(tmp_path.glob("manifest.*"))
    state = spark.createDataFrame([("1", 3, {"2024": 5}, ["9", "7"]), ("2", 1, {}, [])], "category string, page int, per_year map<string,int>, seen array<string>")
    jsonl.save_checkpoint(state, str(tmp_path / "state"))
    back = {r.category: (r.page, r.per_year, r.seen) for r in jsonl.checkpoint_state(spark, str(tmp_path / "state")).collect()}
    assert back == {"1": (3, {"2024": 5}, ["7", "9"]), "2": (1, {}, [])}


def test_stores(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "cast(2020 + id % 3 as int) as annee")
    store.write_by_year(rows, str(tmp_path / "years"), rows_a_file=100)
    back = spark.read.parquet(str(tmp_path / "years"))
    assert back.count() == 1000 and len(list((tmp_path / "years" / "annee=2020").glob("*.parquet"))) >= 4
    (tmp_path / "ref.csv").write_text("company,synthetic\nALPHA,true\n")
    assert [tuple(r) for r in store.read_reference(spark, str(tmp_path / "ref.csv"), "company string, synthetic boolean").collect()] == [("ALPHA", True)]
    (tmp_path / "ref.csv").write_text("company,synthetic\nALPHA,perhaps\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        store.read_reference(spark, str(tmp_path / "ref.csv"), "company string, synthetic boolean").collect()
    options = []
    read = type("R", (), {"format": lambda s, k: s, "option": lambda s, k, v: options.append((k, v)) or s, "options": lambda s, **o: s, "load": lambda s: "loaded"})()
    assert store.read_table(type("S", (), {"read": read})(), "jdbc:x", "t", split="id", low=1, high=9, parts=3) == "loaded"
    assert dict(options) == {"url": "jdbc:x", "dbtable": "t", "partitionColumn": "id", "lowerBound": 1, "upperBound": 9, "numPartitions": 3}


def test_null_rows(spark):
    rows = spark.createDataFrame([("listing", 2024), ("listing", 2023), (None, 2024), ("pv", 2024)], "source string, annee int")
    assert {tuple(r) for r in indicators.without_biased(rows).collect()} == {("listing", 2023), (None, 2024), ("pv", 2024)}
    won = spark.createDataFrame([(1, "w", "b", 2020, 10.0, 1, None), (2, "w", "b", 2020, 10.0, None, "open")], "ref_id int, winner string, buyer string, annee int, award_amount double, number_of_bidders int, procedure string")
    flags = risk.scored(risk.red_flags(won, spark.createDataFrame([(1,)], "ref_id int"), ["open"])).orderBy("ref_id").collect()
    assert [(r.single_bidder, r.closed_procedure, r.excluded_bidders, r.concentration, r.risk_score, r.risk_level) for r in flags] == [(True, False, True, True, 60.0, "Élevé"), (False, False, False, True, 20.0, "Faible")]
    a = spark.createDataFrame([(1, None, "x"), (2, "p", None)], "k int, v string, u string")
    b = spark.createDataFrame([(1, "q", "y"), (3, None, None)], "k int, v string, u string")
    assert {tuple(r) for r in relational.source_priority(a, b, "k", ["v", "u"]).collect()} == {(1, "q", "x", "first"), (2, "p", None, "first"), (3, None, None, "second")}
    left = spark.createDataFrame([(1, "r", "d1"), (None, "r", "d2"), (9, "r", "d3"), (None, None, "d4")], "k int, c string, doc string")
    right = spark.createDataFrame([(1, "r", None), (2, "s", 5.0)], "k int, c string, v double")
    assert {(r.doc, r.v, r.matched_by) for r in relational.fallback_join(left, right, "k", ["c"], ["v"]).collect()} == {("d1", None, "key"), ("d2", None, "composite"), ("d3", None, None), ("d4", None, None)}
    dated = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2023, 1, 2),), (None,)], "d date")
    assert relational.in_years(dated, "d", [2024]).count() == 1
    listed = spark.createDataFrame([("c", None, i) for i in range(3)] + [("c", dt.date(2024, 1, 1), 9), (None, dt.date(2024, 1, 1), 1)], "c string, d date, k int")
    pages = relational.page_numbers(listed, ["c"], "d", "k", 2).collect()
    assert {(r.c, r.k, r.page) for r in pages} == {("c", 9, 0), ("c", 0, 0), ("c", 1, 1), ("c", 2, 1), (None, 1, 0)}
    assert tuple(relational.tallies(spark.createDataFrame([("ok",), (None,)], "o string"), "o", ["ok", "err"]).first()) == (1, 0)
    years = spark.createDataFrame([(2024,), (None,), (2023,)], "y int")
    assert [r.y for r in relational.by_text(years, "y").collect()] == [2023, 2024, None]


def test_share_text_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(1, 200), (3, 200), (5, 200), (2, 3), (0, 0), (1, 8)], "n long, t long")
    got = [r[0] for r in rows.select(T.share_text(F.col("n"), F.col("t"))).collect()]
    assert got == [f"{n} ({n / t * 100:.0f}%)" if t else "-" for n, t in [(1, 200), (3, 200), (5, 200), (2, 3), (0, 0), (1, 8)]]


def test_error_rates_of_whole_texts(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    cases = [("", ""), ("a b c", "a c"), ("mot " * 100, "mat " * 100), ("été à " * 60, "ete a " * 60), ("x", "x y z w"), ("un deux trois quatre", ""), ("début " + "abc def " * 90, "abc def " * 95)]
    df = spark.createDataFrame(cases, "a string, b string").select("a", "b", T.character_errors(F.col("a"), F.col("b")).alias("c"), T.word_errors(F.col("a"), F.col("b")).alias("w"), T.word_count(F.col("a")).alias("n"))
    for r in df.collect():
        x, y = r.a.split(), r.b.split()
        assert (r.c, r.w, r.n) == (distance(r.a, r.b), distance(x, y), len(x))


@pytest.mark.parametrize("band", [1, 2, 5, 63])
def test_edit_distance_in_bands(band, monkeypatch):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    monkeypatch.setattr(edit, "FIRST_BAND", band)
    draw = random.Random(band)
    for _ in range(1500):
        a = [draw.choice("abc") for _ in range(draw.randint(0, 14))]
        b = [draw.choice("abc") for _ in range(draw.randint(0, 14))] if draw.random() < 0.5 else [draw.choice([x, x, x, "z", ""]) for x in a]
        b = [x for x in b if x]
        assert edit.edit_distance(a, b) == distance(a, b)
    long = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    assert edit.edit_distance(long, long[7:] + "xyz") == 10
    assert edit.edit_distance(long, "") == edit.edit_distance("", long) == 3000


def test_errors_within_words_need_no_band(monkeypatch):
    """A long reading whose errors stay within words takes time by its length alone; one of other words is still exact."""
    draw = random.Random(3)
    a = " ".join("".join(draw.choice("abdefgiht") for _ in range(draw.randint(1, 9))) for _ in range(3000))
    b = a.replace("e", "c").replace(" th", " tli")
    want = a.count("e") + 2 * a.count(" th")
    long = []
    within = edit._within
    monkeypatch.setattr(edit, "_within", lambda a, b, places, k: (long.append(len(b)) if len(b) > edit.WORD else None) or within(a, b, places, k))
    assert edit.edit_distance(a, b) == want and not long
    assert edit.edit_distance(a.split(), b.split()) == sum(x != y for x, y in zip(a.split(), b.split(), strict=True)) and not long
    assert edit.edit_distance("e" * 70000, "c" * 70000) == 70000 and not long
    assert edit.edit_distance("ab" * 100 + " x", "ba" * 100 + " x") == 2 and long
    assert edit.edit_distance("\U0001f600e" * 100, "\U0001f600c" * 100) == 100


def test_error_rates_of_nothing(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("", "")], "a string, b string")
    assert [tuple(r) for r in rows.select(T.character_errors(F.col("a"), F.col("b")), T.word_errors(F.col("a"), F.col("b"))).collect()] == [(None, None)] * 3 + [(0, 0)]


def test_words_end_at_separators(spark):
    row = spark.createDataFrame([("a\x1cb c\u2003d", "a b c d")], "a string, b string").select(T.word_errors(F.col("a"), F.col("b")), T.word_count(F.col("a"))).first()
    assert tuple(row) == (0, 4)


def test_late_awards_and_notices(spark, tmp_path):
    source = str(tmp_path / "awards")
    spark.createDataFrame([(1, "w"), (7, "v")], "ref_id int, winner string").write.parquet(source)
    stream = spark.readStream.schema("ref_id int, winner string").parquet(source)
    known = spark.createDataFrame([(1, "objet")], "ref_id int, objet string")
    query = ingest.late_awards(spark, stream, known).writeStream.format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("late").collect()} == {(1, "w", "objet"), (7, "v", None)}
    assert mapped(spark, minutes.is_minutes_notice, ["Un EXTRAIT DE PV", "extrait du pv", "pv", None]) == [True, True, False, None]


def test_stream_keeps_rows_without_a_key(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    spark.createDataFrame([(None, "a"), (None, "a"), (1, "z"), (1, "b")], "k long, v string").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest.ingest(spark, source, root, ["k"], schema).awaitTermination()
    spark.createDataFrame([(None, "c"), (1, "a")], "k long, v string").write.mode("append").parquet(source)
    ingest.ingest(spark, source, root, ["k"], schema).awaitTermination()
    got = sorted((r.k or 0, r.v) for r in spark.read.parquet(f"{root}/table").collect())
    assert got == [(0, "a"), (0, "a"), (0, "c"), (1, "b")]


def test_scratch_goes_with_its_scope(spark):
    import os

    local = lambda p: p.removeprefix("file:")
    with scope(spark):
        inner = stored(spark.range(5), "inner")
        path = local(inner.inputFiles()[0])
        kept = stored(inner, "kept", keep=True)
        assert os.path.exists(path.removeprefix("//"))
    assert not os.path.exists(path.removeprefix("//")) and kept.count() == 5
    delete(spark, scratch_path(spark, "never-there"))


def test_guard_hides_only_absence(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    assert entry._there("tendril") and not entry._there("tendril_that_is_not")
    for name in ("tendril.plans", "tendril.sources", "tendril.operators"):
        assert entry._there(name) and importlib.import_module(name)


def test_isolation_forest_computes_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def made(x):
        seen.add(1)
        return float(x % 7)

    scores = forest.isolation_scores(spark.range(500).select("id", made("id").alias("x")), "id", ["x"], trees=5)
    assert scores.count() == len(scores.collect()) == 500
    assert seen.value == 500
