"""Main text of HTML pages by equivalence classes of template tokens.

Tokens are tags with their place in the page and runs of text with theirs. Over the pages of a host, tokens that
occur equally often in each page have equal occurrence vectors and form a class. Frequent classes, ordered and
nested, are the host's template; what stands in its slots is the pages' own content. Of the slots, those of the
article are kept and turned into blocks of text.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from raretide.llm.common import small_batches, stage

# A class is frequent when it occurs on this share of a host's pages, and on at least this many of them.
SUPPORT, LEAST_PAGES = 0.5, 3
# Template tokens up to which the templates are sent to every task; beyond, pages and templates are joined.
BROADCAST_TOKENS = 1_000_000

# HTML elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math canvas".split())
ASIDE = frozenset("head nav header footer aside form menu button select option dialog".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
MAIN = frozenset("article main".split())
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay toolbar pagination widget skip".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


def _attributes(tag: str, name: str) -> dict[str, str]:
    rest = tag[len(name) + 1:].rstrip("/>")
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if "=" in rest or rest.strip() else {}


def _is_aside(name: str, attributes: dict[str, str]) -> bool:
    if name in ASIDE or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in ASIDE_ROLES:
        return True
    words = re.split(r"[^a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    return name not in MAIN and name not in ("html", "body") and not ASIDE_NAMES.isdisjoint(words)


def tokens(page: str):
    """(kind, value, path, aside, main) of each token in page order.

    ``kind`` is "tag" (value: the element's name, with "/" in front where it ends) or "text" (the run with its
    references as they stand). ``path`` names the open elements with their classes, digits left out. ``aside`` is set
    inside elements that are no part of an article, ``main`` inside article or main elements.
    """
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    position, size = 0, len(page)
    while position < size:
        found = _TOKEN.match(page, position)
        token, position = found[0], found.end()
        if token[0] != "<" or token == "<":
            _, path, aside, main = stack[-1]
            yield "text", token, path, aside, main
            continue
        if token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if any(s[0] == name for s in stack[1:]):
                while stack[-1][0] != name:
                    stack.pop()
                _, path, aside, main = stack.pop()
                yield "tag", "/" + name, path, aside, main
            elif name in ("p", "br"):
                yield "tag", name, stack[-1][1], stack[-1][2], stack[-1][3]
            continue
        attributes = _attributes(token, name)
        if name not in INLINE:  # a new block ends open inline elements and what may not hold it
            ends = CLOSES.get(name, "").split()
            k = len(stack)
            while k > 1 and (stack[k - 1][0] in INLINE or stack[k - 1][0] == "p" or stack[k - 1][0] in ends):
                k -= 1
                if stack[k][0] in ends or stack[k][0] == "p":
                    del stack[k:]
        _, path, aside, main = stack[-1]
        mark = _DIGITS.sub("", ".".join([name, *attributes.get("class", "").lower().split()]))
        own = (name, f"{path}/{mark}", aside or _is_aside(name, attributes), main or name in MAIN or attributes.get("role") == "main")
        yield "tag", name, own[1], own[2], own[3]
        if name in VOID or token.endswith("/>") and name not in RAW | MAIN:
            continue
        if name in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, position)
            position = end.end() if end else size
            continue
        stack.append(own)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def template_key(kind: str, value: str, path: str) -> int:
    """A token's identity across pages: the place, and for text also the text, white space and digits aside."""
    return _hash(f"{kind} {path} {value}" if kind == "tag" else f"{kind} {path} {_DIGITS.sub('0', _BLANKS.sub(' ', value).strip())}")


def host_of(url: str | None) -> str:
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, page, n, place): the distinct tokens of each page, how often they occur and where first.

    Text inside article and main elements is content whatever the host's other pages hold, so it is no candidate.
    """
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("page", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def run(batches):
        for batch in small_batches(batches):
            rows: list[list] = [[], [], [], [], []]
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                seen: dict[int, list[int]] = {}
                for place, (kind, value, path, _, main) in enumerate(tokens(page or "")):
                    if kind == "tag" or not main and not value.isspace():
                        seen.setdefault(template_key(kind, value, path), [0, place])[0] += 1
                host, name = host_of(url), _hash((url or "") + "\0" + (page or ""))
                for token, (n, place) in seen.items():
                    for column, x in zip(rows, (host, token, name, n, place), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    return pages.select("url", "html").mapInArrow(run, "host string, token bigint, page bigint, n int, place int")


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the host's template tokens in page order, each with its class and the depth of its nesting.

    Occurrence vectors are compared by the exclusive or of one hash per page and count, and by their number of
    pages and occurrences, all of which sum up before the shuffle. A frequent token is on half of the host's
    pages, so a template is no longer than two pages' tokens, whatever the number of pages.
    """
    each = page_tokens(pages)
    vectors = each.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("occurrences"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.avg("place").alias("place"))
    vectors = stage(vectors.where(F.col("pages") >= LEAST_PAGES), "occurrence-vectors")
    # The tag that starts a page is on all of them: the largest count of a token is the host's number of pages.
    hosts = vectors.groupBy("host").agg(F.max("pages").alias("all_pages"))
    frequent = vectors.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("all_pages"))
    classes = frequent.groupBy("host", "pages", "occurrences", "vector").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.collect_list(F.struct("place", "token")).alias("members"))
    # A class is nested in those that start before it and end behind it; they come first in this order.
    order = Window.partitionBy("host").orderBy("first", F.col("last").desc(), "vector")
    placed = classes.withColumn("class", F.row_number().over(order))
    depth = F.size(F.filter("spans", lambda s: (s["first"] < F.col("first")) & (s["last"] > F.col("last"))))
    whole = Window.partitionBy("host")
    placed = placed.withColumn("spans", F.collect_list(F.struct("first", "last")).over(whole)).withColumn("depth", depth)
    flat = placed.select("host", F.explode(F.transform("members", lambda m: F.struct(m["place"].alias("place"), m["token"].alias("token"),
                                                                                     F.col("class").alias("class"), F.col("depth").alias("depth")))).alias("m"))
    return flat.groupBy("host").agg(F.sort_array(F.collect_list("m")).alias("template"))


def _slots(page: str, template: list[dict]):
    """The page's slots: runs of tokens between template tokens, with the template's text left out.

    A class counts on this page only if its tokens come in the template's order; one that does not is ignored here.
    """
    parsed = list(tokens(page))
    rank = {m["token"]: i for i, m in enumerate(template)}
    group = {m["token"]: m["class"] for m in template}
    latest: dict[int, int] = {}
    broken, seen = set(), set()
    keys = [template_key(kind, value, path) if kind == "tag" or not main else 0 for kind, value, path, _, main in parsed]
    for key in keys:
        if key in rank and key not in seen:
            seen.add(key)
            if rank[key] < latest.get(group[key], -1):
                broken.add(group[key])
            latest[group[key]] = rank[key]
    slot: list = []
    for key, token in zip(keys, parsed, strict=True):
        if key in rank and group[key] not in broken:
            if token[0] == "tag":
                slot.append(token)  # a tag of the template still ends blocks
            if slot:
                yield slot
            slot = []
        else:
            slot.append(token)
    if slot:
        yield slot


def main_text(page: str, template: list[dict]) -> str:
    """The blocks of the article, joined by an empty line.

    Slots inside article or main elements are the content; on pages without them, all slots that are not set aside.
    """
    slots = list(_slots(page, template))
    inside = any(token[4] for slot in slots for token in slot)
    blocks: list[str] = []
    run: list[str] = []

    def close():
        text = _BLANKS.sub(" ", references.unescape("".join(run))).strip()
        run.clear()
        if text:
            blocks.append(text)

    for slot in slots:
        for kind, value, _, aside, main in slot:
            if kind == "tag":
                if value.lstrip("/") not in INLINE:
                    close()
                elif value == "br":
                    run.append(" ")
            elif not aside and (main or not inside):
                run.append(value)
            elif value.strip():
                close()
    close()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by two line ends, empty if there are none) and n_chars.

    A null page is empty; pages with a null or odd url form a host of their own, and hosts of fewer than three pages
    have no template: there the article's place in the page decides alone. Rows are neither dropped nor merged,
    repeated rows count as one page in the vectors' hash only if they are equal in pairs; other columns are not
    read; an empty table gives an empty result.
    """
    named = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    templates = stage(host_templates(named), "host-templates")
    size = templates.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    small = F.broadcast(templates) if size <= BROADCAST_TOKENS else templates.hint("shuffle_hash")
    joined = named.withColumn("host", host).join(small, "host", "left").select("id", "url", "html", "template")

    def run(batches):
        for batch in small_batches(batches, 64):
            found = [main_text(page or "", template or [])
                     for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [id_column, url_column, "text", "n_chars"])

    return joined.mapInArrow(run, f"{id_column} bigint, {url_column} string, text string, n_chars bigint")
