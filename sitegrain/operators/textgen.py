"""schema.org markup in bulk from texts: plain text with fields, or HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.constants import ADDRESS_FIELDS, SCHEMA_TYPES, SPACE_CLASS
from sitegrain.functions.columns import blank, first, last, let, non_empty, remembered, staged
from sitegrain.functions.jsonld import node, node_if
from sitegrain.functions.text import collapse, strip, word_count
from sitegrain.operators.extract import extract
from sitegrain.operators.suggest import faq_pairs, question_nodes

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
FIELD_LINE = rf"^([A-Za-z][A-Za-z0-9 _-]{{0,40}}){SPACE_CLASS}*:{SPACE_CLASS}*(.+)$"
STEP_LINE = rf"(?i)^{SPACE_CLASS}*(?:step{SPACE_CLASS}*)?(?:\p{{Nd}}+[.)]|[-*•]){SPACE_CLASS}*(.+)$"
TRAIL_BREAK = rf"{SPACE_CLASS}*[>›→/|]{SPACE_CLASS}*"
SENTENCE = rf"(?s)^(.*?[.!?]){SPACE_CLASS}"


def looks_like_html(text: Column) -> Column:
    return strip(text).rlike(r"<\s*[a-zA-Z!/]")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def is_field(line: Column) -> Column:
    """Key of at most three words, and something after the colon."""
    key = collapse(F.regexp_extract(line, FIELD_LINE, 1))
    return line.rlike(FIELD_LINE) & (word_count(key) <= 3) & ~line.endswith(":")


def split_fields(lines: Column) -> tuple[Column, Column]:
    """(array<struct(key, value)> in order, prose lines)."""
    fields = F.transform(
        F.filter(lines, is_field),
        lambda x: F.struct(
            F.replace(F.lower(strip(F.regexp_extract(x, FIELD_LINE, 1))), F.lit(" "), F.lit("")).alias("key"),
            strip(F.regexp_extract(x, FIELD_LINE, 2)).alias("value"),
        ),
    )
    return fields, F.filter(lines, lambda x: ~is_field(x))


def field(*keys: str) -> Column:
    """First of the keys that has a value; a repeated key holds its last."""
    found = [last(F.filter("fields", (lambda k: lambda f: f["key"] == k)(k)))["value"] for k in keys]
    return F.coalesce(*[non_empty(v) for v in found])


def first_sentence(text: Column, limit: int = 300) -> Column:
    return let(
        strip(text),
        lambda t: F.left(
            strip(F.coalesce(non_empty(F.regexp_extract(t, SENTENCE, 1)), t)), F.lit(limit)
        ),
    )


def prepared(texts: DataFrame, html: bool = True) -> DataFrame:
    """(doc_id, content) → what the builders read; one pass for text and HTML.

    Without ``html`` all input is taken as plain text and no markup is read.
    """
    df = texts.select("doc_id", "content")
    if html:
        is_html = looks_like_html(F.coalesce("content", F.lit("")))
        df = staged(df, ["doc_id", "content"], {"is_html": is_html})
        df = df.withColumn("html", F.when(F.col("is_html"), F.col("content")))
        df = df.withColumn("url", F.lit("https://example.invalid/"))
        df = df.withColumn("content", F.when(~F.col("is_html"), F.col("content")).otherwise(F.lit(None)))
        df = df.withColumn("empty_input", blank(strip(F.coalesce("content", "html"))))
        df = extract(df, ["title", "blocks"])
    else:
        df = df.withColumns(
            {
                "is_html": F.lit(False), "title": F.lit(None).cast("string"),
                "empty_input": blank(strip(F.col("content"))),
                "blocks": F.array().cast("array<struct<ord:int,tag:string,text:string,line:int,words:int>>"),
            }
        )
    keep = ["doc_id", "is_html", "empty_input", "title", "blocks"]
    df = staged(df, keep, {"lines": lines_of(F.coalesce("content", F.lit("")))})
    fields, prose = split_fields(F.col("lines"))
    title_field = F.when(
        ~blank(F.col("title")), F.array(F.struct(F.lit("title").alias("key"), F.col("title").alias("value")))
    ).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    texts_of = F.transform("blocks", lambda b: b["text"])
    df = staged(
        df, keep,
        {
            "fields": F.when(F.col("is_html"), title_field).otherwise(fields),
            "prose": F.when(F.col("is_html"), texts_of).otherwise(prose),
        },
    )
    has_blocks = F.size("blocks") > 0
    heads = F.filter("blocks", lambda b: b["tag"].startswith("h"))
    bodies = F.transform(F.filter("blocks", lambda b: ~b["tag"].startswith("h")), lambda b: b["text"])
    return staged(
        df, [*keep, "fields", "prose"],
        {
            "source": F.when(has_blocks, texts_of).otherwise(F.col("prose")),
            "rest": strip(F.array_join(F.slice("prose", F.lit(2), F.greatest(F.size("prose"), F.lit(1))), " ")),
            "head": first(heads)["text"],
            "bodies": F.when(F.size(bodies) > 0, bodies),
        },
    )


def is_step(line: Column) -> Column:
    return line.rlike(STEP_LINE)


@remembered
def detect_type() -> Column:
    """The type a text most resembles, cautiously."""
    src = F.col("source")
    n = lambda p: F.size(F.filter(src, p))
    words = F.aggregate(src, F.lit(0), lambda acc, x: acc + word_count(collapse(x)))
    return (
        F.when(n(lambda x: x.endswith("?")) >= 2, F.lit("FAQPage"))
        .when(n(is_step) >= 2, F.lit("HowTo"))
        .when(field("price", "sku").isNotNull(), F.lit("Product"))
        .when(field("startdate", "start").isNotNull(), F.lit("Event"))
        .when(field(*[k for k, _ in ADDRESS_FIELDS]).isNotNull(), F.lit("LocalBusiness"))
        .when(field("author", "datepublished", "published").isNotNull(), F.lit("Article"))
        .when(words > 120, F.lit("Article"))
        .otherwise(F.lit("WebPage"))
    )


def _messages(*when_text: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in when_text], F.lit(None).cast("string")))


def _made(data: Column, warnings: Column, notes: Column) -> Column:
    """struct(json, warnings, notes); a warning leaves no markup, notes do."""
    return F.struct(
        F.when(F.size(warnings) == 0, F.to_json(data)).alias("json"),
        warnings.alias("warnings"), notes.alias("notes"),
    )


def _article() -> Column:
    given = field("headline", "title", "name")
    from_head = F.when(given.isNull(), F.col("head"))
    pool = F.when(from_head.isNotNull() | (given.isNull() & (F.size("blocks") > 0)), F.coalesce("bodies", "prose")).otherwise(F.col("prose"))

    def built(s: Column) -> Column:
        popped = s["named"].isNull()
        headline = F.coalesce(s["named"], first(s["pool"]))
        body = strip(
            F.array_join(
                F.when(popped, F.slice(s["pool"], F.lit(2), F.greatest(F.size(s["pool"]), F.lit(1)))).otherwise(s["pool"]), " "
            )
        )

        def data(x: Column) -> Column:
            author, date = field("author", "by", "writer"), field("datepublished", "published", "date")
            return _made(
                node(
                    "Article", x["headline"].alias("headline"),
                    F.coalesce(field("description", "summary"), F.when(x["body"] != "", first_sentence(x["body"]))).alias("description"),
                    non_empty(x["body"]).alias("articleBody"),
                    node_if(author, "Person", "name").alias("author"),
                    date.alias("datePublished"), field("image").alias("image"), field("url").alias("url"),
                    node_if(field("publisher"), "Organization", "name").alias("publisher"),
                    context=True,
                ),
                _messages((blank(x["headline"]), "A headline is needed.")),
                _messages((author.isNull(), "No author given."), (date.isNull(), "No publication date given.")),
            )

        return let(F.struct(headline.alias("headline"), body.alias("body")), data)

    return let(F.struct(F.coalesce(given, from_head).alias("named"), pool.alias("pool")), built)


def line_pairs(prose: Column) -> Column:
    """Question lines with the line right below, where that is no question."""
    seen = F.transform(
        prose, lambda x, i: F.struct(F.get(prose, i - 1).alias("name"), x.alias("answer"))
    )
    return F.filter(seen, lambda p: p["name"].endswith("?") & ~p["answer"].endswith("?"))


def _faq() -> Column:
    from_blocks = faq_pairs(F.col("blocks"))
    pairs = let(from_blocks, lambda b: F.when(F.size(b) > 0, b).otherwise(line_pairs(F.col("prose"))))
    return let(
        pairs,
        lambda p: _made(
            node("FAQPage", question_nodes(p).alias("mainEntity"), context=True),
            _messages((F.size(p) == 0, "No question and answer found.")),
            _messages((F.size(p) == 1, "Only one pair found.")),
        ),
    )


def _howto() -> Column:
    steps = F.transform(F.filter("source", is_step), lambda x: strip(F.regexp_extract(x, STEP_LINE, 1)))
    name = F.coalesce(field("name", "title"), first(F.filter("source", lambda x: ~is_step(x))), F.lit("How to"))
    time = field("totaltime", "time", "duration")
    return let(
        steps,
        lambda s: _made(
            node(
                "HowTo", name.alias("name"),
                F.transform(
                    s, lambda x, i: node("HowToStep", (i + 1).alias("position"), x.alias("text"))
                ).alias("step"),
                time.alias("totalTime"), context=True,
            ),
            _messages((F.size(s) == 0, "No steps found.")),
            _messages((time.isNull(), "No duration given.")),
        ),
    )


def _description() -> Column:
    return F.coalesce(field("description"), non_empty(F.col("rest")))


def _named(*keys: str) -> Column:
    return F.coalesce(field(*keys), non_empty(first(F.col("prose"))))


def _address() -> Column:
    """Several keys name one property; the last in table order that is given wins."""
    props: dict[str, list[str]] = {}
    for key, prop in ADDRESS_FIELDS:
        props.setdefault(prop, []).insert(0, key)
    values = {p: field(*keys) for p, keys in props.items()}
    given = F.coalesce(*values.values()).isNotNull()
    return F.when(given, node("PostalAddress", *[v.alias(p) for p, v in values.items()]))


def _organization(kind: str = "Organization") -> Column:
    name = _named("name", "organization", "business", "company")
    local = kind == "LocalBusiness"
    profiles = F.filter(F.transform(F.split(field("sameas", "social", "profiles"), ","), strip), lambda x: x != "")
    return let(
        F.struct(name.alias("name"), _address().alias("address")),
        lambda s: _made(
            node(
                kind, s["name"].alias("name"), field("url").alias("url"), field("logo").alias("logo"),
                field("email").alias("email"), field("telephone", "phone").alias("telephone"),
                field("pricerange").alias("priceRange"), s["address"].alias("address"),
                _description().alias("description"), profiles.alias("sameAs"), context=True,
            ),
            _messages(
                (s["name"].isNull(), "A name is needed."),
                (s["name"].isNotNull() & s["address"].isNull() & F.lit(local), "An address is needed."),
            ),
            _messages((F.lit(local) & s["name"].isNotNull() & field("openinghours", "hours").isNull(), "No opening times given.")),
        ),
    )


def _product() -> Column:
    name = _named("name", "product", "title")
    price = field("price", "cost")
    currency = field("currency", "pricecurrency")
    stock = field("availability", "stock")
    offer = F.when(
        price.isNotNull(),
        node(
            "Offer",
            F.coalesce(non_empty(F.regexp_replace(price, r"[^\p{Nd}.]", "")), price).alias("price"),
            F.coalesce(currency, F.lit("GBP")).alias("priceCurrency"),
            F.concat(F.lit("https://schema.org/"), F.replace(strip(stock), F.lit(" "), F.lit(""))).alias("availability"),
            field("url").alias("url"),
        ),
    )
    return let(
        name,
        lambda n: _made(
            node(
                "Product", n.alias("name"), _description().alias("description"), field("sku").alias("sku"),
                field("mpn").alias("mpn"), field("image").alias("image"),
                node_if(field("brand", "manufacturer"), "Brand", "name").alias("brand"),
                offer.alias("offers"), context=True,
            ),
            _messages((n.isNull(), "A product name is needed.")),
            _messages(
                (price.isNull(), "No price given."),
                (price.isNotNull() & currency.isNull(), "No currency given; GBP was assumed."),
            ),
        ),
    )


def _event() -> Column:
    name = _named("name", "event", "title")
    start = field("startdate", "start", "date", "when")
    place = field("location", "venue", "where")
    return let(
        name,
        lambda n: _made(
            node(
                "Event", n.alias("name"), start.alias("startDate"), field("enddate", "end").alias("endDate"),
                node_if(place, "Place", "name").alias("location"), _description().alias("description"),
                field("url").alias("url"), field("image").alias("image"),
                node_if(field("organizer", "organiser", "host"), "Organization", "name").alias("organizer"),
                context=True,
            ),
            _messages(
                (n.isNull(), "An event name is needed."),
                (n.isNotNull() & start.isNull(), "A start date is needed."),
            ),
            _messages((place.isNull(), "No location given.")),
        ),
    )


def _breadcrumbs() -> Column:
    trail = F.coalesce(field("breadcrumb", "trail", "path"), first(F.col("prose")), F.lit(""))
    crumbs = F.filter(F.transform(F.split(trail, TRAIL_BREAK), strip), lambda x: x != "")
    base = F.rtrim(F.coalesce(field("url", "baseurl"), F.lit("")), F.lit("/"))

    def items(s: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            slug = F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))
            return F.struct(
                F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x.alias("name"),
                F.when(
                    s["base"] != "",
                    F.concat(s["base"], F.lit("/"), F.when(i == 0, F.lit("")).otherwise(slug)),
                ).alias("item"),
            )

        return _made(
            node("BreadcrumbList", F.transform(s["crumbs"], entry).alias("itemListElement"), context=True),
            _messages((F.size(s["crumbs"]) < 2, "A trail of at least two levels is needed.")),
            _messages((s["base"] == "", "No URL given, so no links.")),
        )

    return let(F.struct(crumbs.alias("crumbs"), base.alias("base")), items)


def _webpage() -> Column:
    n = F.coalesce(field("name", "title"), non_empty(first(F.col("prose"))))
    sentence = F.when(F.size("prose") > 1, non_empty(first_sentence(F.col("rest"))))
    return let(
        n,
        lambda name: _made(
            node(
                "WebPage", name.alias("name"), F.coalesce(field("description"), sentence).alias("description"),
                field("url").alias("url"), field("lang", "language").alias("inLanguage"), context=True,
            ),
            _messages((name.isNull(), "A page title is needed.")),
            _messages(),
        ),
    )


BUILDERS = {
    "Article": _article, "FAQPage": _faq, "HowTo": _howto, "Organization": _organization,
    "LocalBusiness": lambda: _organization("LocalBusiness"), "Product": _product, "Event": _event,
    "BreadcrumbList": _breadcrumbs, "WebPage": _webpage,
}


@remembered
def built(kind: str) -> Column:
    return BUILDERS[kind]()


def generate(texts: DataFrame, schema_type: str = "auto", html: bool = True) -> DataFrame:
    """(doc_id, content) → doc_id, schema_type, json_ld ('' if none), warnings, notes."""
    df = prepared(texts, html)
    if schema_type not in SCHEMA_TYPES:
        wrong = F.array(F.lit(f"Unknown schema type {schema_type}."))
        return df.select(
            "doc_id", F.lit(schema_type).alias("schema_type"), F.lit("").alias("json_ld"),
            wrong.alias("warnings"), F.array().cast("array<string>").alias("notes"),
        )
    auto = schema_type == "auto"
    kind = detect_type() if auto else F.lit(schema_type)
    df = staged(df, df.columns, {"kind": F.when(F.col("empty_input"), F.lit(schema_type)).otherwise(kind)})
    if auto:
        # Only the branch of the detected type is evaluated.
        made = F.lit(None).cast("struct<json:string,warnings:array<string>,notes:array<string>>")
        for name in BUILDERS:
            made = F.when(F.col("kind") == name, built(name)).otherwise(made)
    else:
        made = built(schema_type)
    empty = F.array(F.lit("Nothing to work with."))
    none = F.array().cast("array<string>")
    df = staged(df, ["doc_id", "kind", "empty_input"], {"made": F.when(~F.col("empty_input"), made)})
    said = F.array(F.concat(F.lit("Detected "), F.col("kind"), F.lit("."))) if auto else none
    return df.select(
        "doc_id", F.col("kind").alias("schema_type"),
        F.coalesce("made.json", F.lit("")).alias("json_ld"),
        F.when(F.col("empty_input"), empty).otherwise(F.coalesce("made.warnings", none)).alias("warnings"),
        F.when(F.col("empty_input"), none).otherwise(F.concat(said, F.coalesce("made.notes", none))).alias("notes"),
    )
