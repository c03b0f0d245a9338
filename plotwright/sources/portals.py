"""Stored portal pages to listing rows.

A page table has ``html`` and ``type`` (flat, house), optionally ``town``. Pages that embed JSON are
read with JVM expressions; pages of cards go through an Arrow-batched parser. Pages that do not hold
what is expected give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.addresses import district_of_place, dotted_date, town_of_place
from plotwright.functions.numbers import price_before_unit, rooms_from_word, to_float, to_int
from plotwright.session import materialize
from plotwright.sources.schemas import LISTING, names

# Last parts of schema.org availabilities of closed offers.
CLOSED = ("OutOfStock", "SoldOut", "Discontinued")

_OTODOM = """struct<props:struct<pageProps:struct<data:struct<searchAds:struct<items:array<struct<id:bigint,estate:string,slug:string,title:string,market:string,
  totalPrice:struct<value:double>,pricePerSquareMeter:struct<value:double>,areaInSquareMeters:double,terrainAreaInSquareMeters:double,roomsNumber:string,floorNumber:string,
  location:struct<address:struct<city:struct<name:string>,district:struct<name:string>,street:struct<name:string>>>,isPrivateOwner:boolean,agency:struct<name:string>,
  images:array<struct<medium:string,large:string>>,dateCreated:string>>>>>>>"""
_OLX = """struct<listing:struct<listing:struct<ads:array<struct<id:bigint,url:string,title:string,partner:struct<code:string>,externalUrl:string,price:struct<regularPrice:struct<value:double>>,
  params:array<struct<key:string,value:string,normalizedValue:string>>,location:struct<cityName:string,districtName:string>,photos:array<string>,user:struct<name:string>,isBusiness:boolean,lastRefreshTime:string,createdTime:string>>>>>"""
_COLLECTION = """struct<`@type`:string,mainEntity:struct<offers:array<struct<offers:array<struct<availability:string,price:string,url:string,name:string,image:string,priceSpecification:struct<price:string>,
  itemOffered:struct<description:string,address:struct<streetAddress:string,addressLocality:string>,floorSize:struct<value:string>,numberOfRooms:string>>>>>>>"""


def _listing(rows: DataFrame, **columns: Column) -> DataFrame:
    """All listing columns in order; what a source does not tell is null."""
    kinds = dict(f.strip().split(" ") for f in LISTING.split(", "))
    return rows.select(*[columns.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names(LISTING)])


def otodom(pages: DataFrame, base: str = "https://www.otodom.pl") -> DataFrame:
    """Search pages with a ``__NEXT_DATA__`` script; flats and houses only."""
    data = F.from_json(F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), _OTODOM)
    ads = pages.select("type", F.explode(data["props"]["pageProps"]["data"]["searchAds"]["items"]).alias("a")).filter(F.col("a.estate").isin("HOUSE", "FLAT"))
    c, where = F.col, "a.location.address"
    first = F.get(c("a.images"), F.lit(0))
    return _listing(
        ads, source=F.lit("otodom"), source_id=c("a.id"), url=F.when(c("a.slug") != "", F.concat(F.lit(f"{base}/pl/oferta/"), c("a.slug"))), title=c("a.title"), type=c("type"), price=F.bround(c("a.totalPrice.value"), 0),
        area=c("a.areaInSquareMeters"), price_per_m2=c("a.pricePerSquareMeter.value"), rooms=rooms_from_word(F.when(~c("a.roomsNumber").rlike("^[0-9]"), c("a.roomsNumber"))), plot_area=c("a.terrainAreaInSquareMeters"), floor=c("a.floorNumber"),
        locality=c(f"{where}.city.name"), district=c(f"{where}.district.name"), street=c(f"{where}.street.name"), is_private=c("a.isPrivateOwner"), market=F.nullif(F.lower(c("a.market")), F.lit("")),
        agency=c("a.agency.name"), image=F.coalesce(F.nullif(first["medium"], F.lit("")), first["large"]), created=c("a.dateCreated"), archived=F.lit(False),
    )


def olx(pages: DataFrame) -> DataFrame:
    """Pages with a state encoded as a JSON text inside a JavaScript string; syndicated and priceless advertisements are left out."""
    quoted = F.regexp_extract("html", r'(?s)__PRERENDERED_STATE__\s*=\s*"(.*?)";', 1)
    inner = F.from_json(F.concat(F.lit('{"s":"'), quoted, F.lit('"}')), "s string")["s"]
    ads = pages.select("type", F.explode(F.from_json(inner, _OLX)["listing"]["listing"]["ads"]).alias("a"))
    value = F.col("a.price.regularPrice.value")
    ads = ads.filter((F.coalesce(F.col("a.partner.code"), F.lit("")) == "") & (F.coalesce(F.col("a.externalUrl"), F.lit("")) == "") & (F.coalesce(value, F.lit(0.0)) != 0))

    def param(key: str) -> Column:
        """The last parameter of a key: its normalised value, else its value."""
        hit = F.try_element_at(F.filter("a.params", lambda p: p["key"] == key), F.lit(-1))
        return F.coalesce(F.nullif(hit["normalizedValue"], F.lit("")), hit["value"])

    c, business = F.col, F.coalesce(F.col("a.isBusiness"), F.lit(False))
    return _listing(
        ads, source=F.lit("olx"), source_id=c("a.id"), url=c("a.url"), title=c("a.title"), type=c("type"), price=F.bround(value, 0), area=to_float(param("m")), price_per_m2=to_int(param("price_per_m")), rooms=rooms_from_word(param("rooms")),
        plot_area=F.when(c("type") == "house", to_float(param("area"))), floor=param("floor_select"), locality=c("a.location.cityName"), district=c("a.location.districtName"), is_private=~business, market=F.lower(param("market")),
        agency=F.when(business, c("a.user.name")), image=F.get(c("a.photos"), F.lit(0)), created=F.coalesce(F.nullif(c("a.lastRefreshTime"), F.lit("")), c("a.createdTime")), archived=F.lit(False),
    )


def nieruchomosci_online(pages: DataFrame) -> DataFrame:
    """Pages whose first JSON-LD ``CollectionPage`` lists the offers; rentals are left out, closed offers marked."""
    blocks = F.transform(F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1)), lambda b: F.from_json(F.trim(b), _COLLECTION))
    page = F.get(F.filter(blocks, lambda b: b["@type"] == "CollectionPage"), F.lit(0))
    town = F.col("town") if "town" in pages.columns else F.lit(None).cast("string")
    offers = pages.select("type", F.initcap(town).alias("town"), F.explode(F.get(page["mainEntity"]["offers"], F.lit(0))["offers"]).alias("o"))
    offers = offers.filter(~F.contains(F.coalesce(F.col("o.url"), F.lit("")), F.lit("na-wynajem")))
    c, number, blank = F.col, F.regexp_extract("o.url", r"/(\d+)\.html", 1), F.lit("")
    return _listing(
        offers, source=F.lit("nieruchomosci-online"), source_id=F.when(number != "", number).otherwise(c("o.url")), url=c("o.url"), title=F.coalesce(F.nullif(c("o.name"), blank), c("o.itemOffered.description")), type=c("type"),
        price=to_int(c("o.price")), area=to_float(c("o.itemOffered.floorSize.value")), price_per_m2=to_int(c("o.priceSpecification.price")), rooms=to_int(c("o.itemOffered.numberOfRooms")),
        locality=F.coalesce(F.nullif(c("o.itemOffered.address.addressLocality"), blank), c("town")), street=F.nullif(c("o.itemOffered.address.streetAddress"), blank), image=c("o.image"),
        archived=F.coalesce(F.substring_index(c("o.availability"), "/", -1).isin(*CLOSED), F.lit(False)),
    )


class _Cards(HTMLParser):
    """Texts and attributes of the marked elements of each card on a page."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards, self.stack, self.card = [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        mark = a.get("data-cy")
        if mark == "card" and self.card is None:
            self.card = {"texts": {}, "links": [], "images": []}
            self.cards.append(self.card)
            self.depth = len(self.stack)
        if self.card is not None:
            if tag == "a" and a.get("href"):
                self.card["links"].append((mark == "propertyUrl", a["href"]))
            if tag == "img":
                thumb = mark == "gallerySliderImgThumbnail" or "gallery-slider__img" in (a.get("class") or "").split()
                self.card["images"].append((thumb, a.get("src") or "", a.get("srcset") or a.get("data-srcset") or ""))
            if mark and mark not in self.card["texts"]:
                self.card["texts"][mark] = []
        if tag not in self.VOID:
            self.stack.append((tag, mark if self.card is not None else None))

    def handle_endtag(self, tag):
        while self.stack:
            top, _ = self.stack.pop()
            if self.card is not None and len(self.stack) <= self.depth:
                self.card = None
            if top == tag:
                break

    def handle_data(self, data):
        if self.card is not None and data.strip():
            for mark in {m for _, m in self.stack if m in self.card["texts"]}:
                self.card["texts"][mark].append(data.strip())


#: Pictures of a card that may show the property, best first: (wants the gallery mark, where the address stands).
_PICTURE_RULES = ((True, "src"), (True, "srcset"), (False, "src"))


def _card_image(images: list[tuple[bool, str, str]]) -> str | None:
    """Address of a card's picture: of the first marked picture, or, where none is marked, of the first that is no icon."""
    marked = [i for i in images if i[0]]
    for wants_mark, where in _PICTURE_RULES:
        if wants_mark != bool(marked):
            continue
        for is_marked, src, srcset in marked[:1] or images:
            address = src if where == "src" else (srcset.split() or [""])[0]
            icon = where == "src" and address.endswith(".svg") or not is_marked and "nuxt-assets" in address
            if address.startswith("http") and not icon:
                return address
    return None


# The marks that carry a card's texts.
_MARKS = {
    "title": "propertyCardTitle", "place": "propertyCardLocation", "offer_price": "cardPropertyOfferPrice", "price": "propertyCardPrice",
    "ppm": "offerPricePerM2", "area": "cardPropertyInfoArea", "rooms": "cardPropertyInfoRooms", "added": "descriptionAddedAtDate",
}


def _card_rows(batches):
    columns = ["type", "href", "image", *_MARKS]
    for b in batches:
        out = []
        for html, kind in zip(b["html"].to_pylist(), b["type"].to_pylist()):
            parser = _Cards()
            parser.feed(html or "")
            for card in parser.cards:
                links = [h for marked, h in card["links"] if marked] or [h for _, h in card["links"]]
                if links:
                    text = {k: " ".join(card["texts"][m]) if m in card["texts"] else None for k, m in _MARKS.items()}
                    out.append((kind, links[0], _card_image(card["images"]), *[text[k] for k in _MARKS]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * len(columns))], names=columns)


def _cards(pages: DataFrame, source: str, base: str, id_pattern: str, id_prefix: str, cities: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in ["type", "href", "image", *_MARKS])
    rows = pages.select("html", "type").mapInArrow(_card_rows, schema)
    url = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base), "href"))
    number = F.regexp_extract(url, id_pattern, 1)
    return _listing(
        rows, source=F.lit(source), source_id=F.when(number != "", F.concat(F.lit(id_prefix), number)).otherwise(url), url=url, title=F.col("title"), type=F.col("type"),
        price=price_before_unit(F.coalesce(F.nullif("offer_price", F.lit("")), F.col("price"))), area=to_float(F.substring_index("area", "m", 1)), price_per_m2=price_before_unit(F.col("ppm")), rooms=to_int(F.col("rooms")),
        locality=town_of_place(F.col("place"), cities=cities), district=district_of_place(F.col("place")), image=F.col("image"), created=dotted_date(F.col("added")), archived=F.lit(False),
    )


def gratka(pages: DataFrame, base: str = "https://gratka.pl", cities: tuple[str, ...] = ()) -> DataFrame:
    """Pages of marked cards."""
    return _cards(pages, "gratka", base, r"/(\d+)(?:$|[/?])", "", cities)


def morizon(pages: DataFrame, base: str = "https://www.morizon.pl", cities: tuple[str, ...] = ()) -> DataFrame:
    """Pages of marked cards whose addresses end in a prefixed number."""
    return _cards(pages, "morizon", base, r"mzn(\d+)", "mzn", cities)


#: Sources by name; a new portal is one more function from pages to listing rows.
SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {"otodom": otodom, "olx": olx, "gratka": gratka, "morizon": morizon, "nieruchomosci-online": nieruchomosci_online}


#: Sources whose pages repeat advertisements within a scan; the first of an address is kept.
REPEATING = ("gratka", "morizon", "nieruchomosci-online")


def scan(pages: dict[str, DataFrame], sources: dict[str, Callable] = SOURCES, repeating: tuple[str, ...] = REPEATING) -> tuple[DataFrame, dict[str, str]]:
    """All rows of all sources with ``ordinal`` (their order in the scan; ``repeating`` sources keep the first of an address and type), and the sources that failed.

    Every source is read and written to the work folder by itself, so one that fails, in planning or on a bad page, is
    reported and left out; with none left this raises.
    """
    parts, failed = [], {}
    for name, page in pages.items():
        try:
            parts.append(materialize(sources[name](page).withColumn("ordinal", F.monotonically_increasing_id()), f"scan-{name}"))
        except Exception as error:  # noqa: BLE001 - one broken portal must not stop the others
            failed[name] = str(error).splitlines()[0]
    if not parts:
        raise ValueError(f"no source could be read: {failed}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return distinct_in_scan(rows, repeating), failed


def distinct_in_scan(rows: DataFrame, repeating: tuple[str, ...] = REPEATING) -> DataFrame:
    """``rows`` without later repetitions (by ``ordinal``) of an address within a repeating source and type; rows without address stay."""
    again = F.col("source").isin(*repeating) & F.col("url").isNotNull()
    first = rows.filter(again).groupBy("source", "type", "url").agg(F.min("ordinal").alias("ordinal"))
    kept = rows.filter(again).alias("r").join(first.alias("f"), (F.col("r.source") == F.col("f.source")) & F.col("r.type").eqNullSafe(F.col("f.type")) & (F.col("r.url") == F.col("f.url")) & (F.col("r.ordinal") == F.col("f.ordinal")), "left_semi")
    return rows.filter(~F.coalesce(again, F.lit(False))).unionByName(kept)


def split_archived(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, archived) rows."""
    gone = F.coalesce("archived", F.lit(False))
    return rows.filter(~gone), rows.filter(gone)


# Where portals keep the pictures of an advertisement.
PICTURE_FILES = {
    "olx": r'https://[a-z]+\.apollo\.olxcdn\.com:?\d*/v1/files/[^"\\\s]+',
    "gratka": r'https://thumbs\.cdngr\.pl/thumb/[^"\s]+?\.jpg',
    "nieruchomosci-online": r'https://i\.st-nieruchomosci-online\.pl/[^"\s]+?\.(?:jpg|jpeg|webp)',
}
# Words in addresses of pictures that show no property.
NO_PROPERTY = "(?i)contact|logo|avatar|agent|baner|stopka|ikona|placeholder"
_AD = "struct<props:struct<pageProps:struct<ad:struct<images:array<struct<large:string,medium:string>>>>>>"


def gallery(source: Column, html: Column, most: int = 5) -> Column:
    """First distinct picture addresses of a stored advertisement page, by portal."""
    found = {name: F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))) for name, pattern in PICTURE_FILES.items()}
    file_id = lambda u: F.regexp_extract(u, r"/files/([^/]+)", 1)
    listed = F.from_json(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), _AD)["props"]["pageProps"]["ad"]["images"]
    found["otodom"] = F.array_distinct(F.transform(listed, lambda i: F.coalesce(F.nullif(i["large"], F.lit("")), i["medium"])))
    # Sizes of one file are one picture.
    files = found["olx"]
    found["olx"] = F.filter(files, lambda u, i: F.array_position(F.transform(files, file_id), file_id(u)) == i + 1)
    found["nieruchomosci-online"] = F.filter(found["nieruchomosci-online"], lambda u: ~u.rlike(NO_PROPERTY))
    out = F.lit(None).cast("array<string>")
    for name, urls in found.items():
        out = F.when(source == name, urls).otherwise(out)
    return F.slice(F.coalesce(F.filter(out, lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>")), 1, most)
