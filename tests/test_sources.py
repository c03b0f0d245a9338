import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plotwright.operators.deeds import clean_deeds
from plotwright.sources import portals as P
from plotwright.sources import tables as T
from plotwright.sources.schemas import LISTING, OVERRIDE, names
from tests.fixtures import as_set, rows


def pages(spark, html, kind="flat", town=None):
    return spark.createDataFrame([(h, kind, town) for h in ([html] if isinstance(html, str) else html)], "html string, type string, town string")


def test_json_script(spark):
    ad = {"id": 5, "estate": "FLAT", "slug": "x-ID5", "title": "t", "market": "PRIMARY", "totalPrice": {"value": 100.0}, "areaInSquareMeters": 40.5, "roomsNumber": "THREE", "location": {"address": {"city": {"name": "A"}, "street": None}}, "isPrivateOwner": False, "images": [{"medium": "", "large": "l.jpg"}], "dateCreated": "2024-01-01"}
    items = [ad, ad | {"estate": "INVESTMENT"}, ad | {"id": 6, "slug": None, "roomsNumber": "MORE", "images": []}]
    html = '<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"data": {"searchAds": {"items": items}}}}}) + "</script>"
    got = P.otodom(pages(spark, [html, "no script", None])).collect()
    assert [(r.source_id, r.url, r.rooms, r.image, r.market, r.locality, r.price, r.archived) for r in got] == [("5", "https://www.otodom.pl/pl/oferta/x-ID5", 3, "l.jpg", "primary", "A", 100, False), ("6", None, None, None, "primary", "A", 100, False)]


def test_doubly_encoded_state(spark):
    ad = {"id": 1, "url": "u1", "title": 'say "hi"', "price": {"regularPrice": {"value": 250000}}, "params": [{"key": "m", "value": "45,5 m", "normalizedValue": "45.5"}, {"key": "rooms", "value": "x", "normalizedValue": "two"}, {"key": "area", "value": "800"}], "location": {"cityName": "C", "districtName": "D"}, "photos": ["p"], "isBusiness": True, "user": {"name": "Firm"}, "createdTime": "2024"}
    ads = [ad, ad | {"id": 2, "partner": {"code": "oto"}}, ad | {"id": 3, "externalUrl": "e"}, ad | {"id": 4, "price": None}, ad | {"id": 5, "isBusiness": False, "lastRefreshTime": "2025"}]
    html = "window.__PRERENDERED_STATE__= " + json.dumps(json.dumps({"listing": {"listing": {"ads": ads}}})) + ";"
    got = P.olx(pages(spark, html, "house")).collect()
    assert [(r.source_id, r.title, r.area, r.rooms, r.plot_area, r.agency, r.is_private, r.created) for r in got] == [("1", 'say "hi"', 45.5, 2, 800.0, "Firm", False, "2024"), ("5", 'say "hi"', 45.5, 2, 800.0, None, True, "2025")]


def test_json_ld(spark):
    offer = {"availability": "https://schema.org/InStock", "price": "", "url": "https://a.nol/x/77.html", "name": "n", "image": "i", "priceSpecification": {"price": "5 000"}, "itemOffered": {"address": {"addressLocality": ""}, "floorSize": {"value": "50,25"}, "numberOfRooms": 2}}
    offers = [offer, offer | {"url": "https://a/na-wynajem/1.html"}, offer | {"availability": "https://schema.org/SoldOut", "price": "199 999,50", "url": "https://a/none"}]
    ld = lambda o: f'<script type="application/ld+json">{o}</script>'
    html = ld("{broken") + ld(json.dumps({"@type": "Other"})) + ld(json.dumps({"@type": "CollectionPage", "mainEntity": {"offers": [{"offers": offers}]}}))
    got = P.nieruchomosci_online(pages(spark, html, town="nowy targ")).collect()
    assert [(r.source_id, r.price, r.area, r.price_per_m2, r.rooms, r.locality, r.archived) for r in got] == [("77", None, 50.25, 5000.0, 2, "Nowy Targ", False), ("https://a/none", 200000, 50.25, 5000.0, 2, "Nowy Targ", True)]


CARD = """<div data-cy="card"><a data-cy="propertyUrl" href="/oferta/{id}"><span data-cy="propertyCardTitle">Dom <b>z ogrodem</b></span></a><img src="https://x/icon.svg"><img src="https://x/real.jpg">
<p data-cy="propertyCardLocation">Krótka, Śródmieście, Miasto, śląskie</p><p data-cy="propertyCardPrice">1 250 000 zł<br></p><i data-cy="offerPricePerM2">8 333 zł/m²</i><i data-cy="cardPropertyInfoArea">150,5 m²</i><i data-cy="cardPropertyInfoRooms">5 pokoi</i><u data-cy="descriptionAddedAtDate">dodane 2024.05.06</u></div>"""


def test_cards(spark):
    html = f"<html><div>{CARD.format(id='123')}{CARD.format(id='456?x=1')}</div><div data-cy='card'>no link</div></html>"
    got = P.gratka(pages(spark, [html, "", None], "house")).collect()
    assert [(r.source_id, r.url, r.title, r.price, r.area, r.price_per_m2, r.rooms, r.locality, r.district, r.created, r.image) for r in got] == [
        (i, f"https://gratka.pl/oferta/{u}", "Dom z ogrodem", 1250000, 150.5, 8333.0, 5, "Miasto", "Krótka, Śródmieście", "2024-05-06", "https://x/real.jpg") for i, u in (("123", "123"), ("456", "456?x=1"))
    ]
    assert P.morizon(pages(spark, CARD.format(id="mzn9"))).first()["source_id"] == "mzn9"


def test_scan_unites_sources_and_survives_a_broken_one(spark):
    def broken(_):
        raise RuntimeError("layout changed")

    html = CARD.format(id=1) + CARD.format(id=1) + CARD.format(id=2)
    got, failed = P.scan({"gratka": pages(spark, html), "bad": pages(spark, "")}, {"gratka": P.gratka, "bad": broken})
    assert got.count() == 2 and set(failed) == {"bad"} and set(names(LISTING)) < set(got.columns)
    late = lambda p: P.gratka(p).withColumn("price", F.raise_error(F.lit("bad page")).cast("bigint"))
    got, failed = P.scan({"gratka": pages(spark, html), "late": pages(spark, html)}, {"gratka": P.gratka, "late": late})
    assert got.count() == 2 and set(failed) == {"late"}
    with pytest.raises(ValueError):
        P.scan({"bad": pages(spark, "")}, {"bad": broken})


def test_gallery(spark):
    olx = ' "https://ireland.apollo.olxcdn.com:443/v1/files/a1/image;s=1" "https://ireland.apollo.olxcdn.com:443/v1/files/a1/image;s=2" "https://ireland.apollo.olxcdn.com:443/v1/files/b2/image"'
    nol = ' "https://i.st-nieruchomosci-online.pl/logo.jpg" "https://i.st-nieruchomosci-online.pl/a.jpg" "https://i.st-nieruchomosci-online.pl/a.jpg"'
    df = spark.createDataFrame([("olx", olx), ("nieruchomosci-online", nol), ("morizon", nol)], "source string, html string")
    got = [r[0] for r in df.select(P.gallery(F.col("source"), F.col("html"))).collect()]
    assert [len(g) for g in got] == [2, 1, 0]


XML = """<wfs:FeatureCollection><wfs:member><ms:lokale gml:id="1"><ms:msGeometry><gml:Point>9</gml:Point></ms:msGeometry><ms:dok_data>2024-03-05T00:00:00+01:00</ms:dok_data><ms:tran_rodzaj_trans>wolnyRynek</ms:tran_rodzaj_trans>
<ms:tran_rodzaj_rynku>wtorny</ms:tran_rodzaj_rynku><ms:lok_cena_brutto>{c}</ms:lok_cena_brutto><ms:tran_cena_brutto>300000.5</ms:tran_cena_brutto><ms:lok_pow_uzyt>48.5</ms:lok_pow_uzyt><ms:lok_liczba_izb>2.0</ms:lok_liczba_izb><ms:lok_nr_kond/>
<ms:lok_adres>MSC:Miasto;UL:Krótka: boczna;NR_PORZ:7</ms:lok_adres><ms:lok_funkcja>{f}</ms:lok_funkcja><ms:lok_id_lokalu>1_4.5.6_BUD.1_LOK</ms:lok_id_lokalu></ms:lokale></wfs:member></wfs:FeatureCollection>"""


def test_register_pages_and_cleaning(spark):
    xml = spark.createDataFrame([(XML.format(c="0", f="mieszkalna"),), (XML.format(c="250000", f=""),), (XML.format(c="250000", f="garaz"),), ("<ows:ExceptionReport/>",)], "xml string")
    got = clean_deeds(T.register_features(xml, "flat"), "flat").orderBy("c").collect()
    assert [(r.d, r.c, r.a, r.izb, r.kond, r.rynek, r.msc, r.ul, r.nr, r.dz) for r in got] == [(dt.date(2024, 3, 5), c, 48.5, 2, None, "w", "Miasto", "Krótka: boczna", "7", "1_4.5.6") for c in (250000, 300000)]


def test_versions_snapshots_and_overrides(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    assert T.read_or_empty(spark, root, "a int").count() == 0 and T.current_version(spark, root) is None
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,), (3,)], "a int")
    day = dt.date(2024, 1, 1)
    assert T.refresh(spark, root, lambda: one, day).count() == 1
    assert T.refresh(spark, root, lambda: two, day + dt.timedelta(6)).count() == 1
    assert T.refresh(spark, root, lambda: two, day + dt.timedelta(7)).count() == 2

    def fail():
        raise OSError("offline")

    assert T.refresh(spark, root, fail, day + dt.timedelta(99)).count() == 2
    old = rows(spark, OVERRIDE, {"url": "a", "street": "s", "rooms": 2})
    new = rows(spark, OVERRIDE, {"url": "a", "rooms": 3}, {"url": "b", "nr": "1"})
    assert as_set(T.pin(old, new).select("url", "street", "rooms", "nr")) == {("a", "s", 3, None), ("b", None, None, "1")}


def test_published_runs(spark, tmp_path):
    cards = spark.createDataFrame([(1, None, "flat", "2024-01", None, True), (2, "olx", None, "2024-02", [[1]], None)], "seq bigint, source string, type string, created string, phashes array<array<bigint>>, relisted boolean")
    gone = spark.createDataFrame([(1, "x"), (2, None)], "record_id bigint, sold string")
    funnel = spark.createDataFrame([("matched", 3)], "stage string, n bigint")
    for _ in range(2):  # versions stand side by side
        paths = T.publish(cards, gone, f"file://{tmp_path}/out", cards.unionByName(cards), funnel, {"olx": "late"})
    assert [r["seq"] for r in spark.read.json(paths["listings"]).collect()] == [2, 1] and spark.read.json(paths["archive"]).count() == 2
    row = spark.read.json(paths["meta"]).first()
    assert (row["count"], row["raw"], row["relisted"], row["archive"], row["sold_confirmed"]) == (2, 4, 1, 2, 1)
    assert row["by_source"].asDict() == {"olx": 2, "unknown": 2} and row["by_type"].asDict() == {"flat": 1, "unknown": 1} and row["funnel"]["matched"] == 3 and row["errors"]["olx"] == "late"
    assert T.run_summary(cards.limit(0), gone.limit(0), cards.limit(0)).first()["count"] == 0


def test_unreadable_state_is_empty_and_repeated_pins_count_once(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_bytes(b"no parquet at all")
    assert T.read_or_empty(spark, f"file://{tmp_path}/broken", "a int").count() == 0
    new = rows(spark, OVERRIDE, {"url": "a", "rooms": 3}, {"url": "a", "rooms": 4, "nr": "7"}, {"url": None, "rooms": 1})
    assert as_set(T.pin(rows(spark, OVERRIDE), new).select("url", "rooms", "nr")) == {("a", 4, "7")}


def test_conditions_and_columns_reach_the_scan(spark, tmp_path):
    schema = "kind string, msc string, d date, a double, x double, y double, extra string"
    rows(spark, schema, {"kind": "flat", "msc": "T", "d": dt.date(2024, 2, 1), "a": 50.0, "x": 1.0, "y": 1.0}, {"kind": "flat", "msc": "T", "a": 50.0, "x": 9.0, "y": 1.0}, {}).write.parquet(f"{tmp_path}/deeds")
    got = T.register_table(spark, f"{tmp_path}/deeds", "flat", "T", dt.date(2024, 1, 1), (40, 60), (0, 0, 2), ("a",))
    assert [r["a"] for r in got.collect()] == [50.0] and T.register_table(spark, f"{tmp_path}/deeds").count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "extra" not in plan and "IsNotNull(kind)" in pushed and "ReadSchema" in pushed
