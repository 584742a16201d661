"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its tags (name, class, id and role) and its texts. Over the pages of one host every token
has an occurrence vector, its count in each page; Spark sums count x hash(page) into a signature, so tokens
with equal vectors meet in one group without any vector being built, and a host with a third of all pages
combines map-side. The tags that occur exactly once in a SHARE of the pages that have any tag are the skeleton, so that an empty, cut or
odd page takes nothing from its host; their order is read off one page that has them all. Other classes are nested into the skeleton's slot that holds them.
Texts that are as frequent are template texts if they are in the skeleton's class or share the vector of a nested class of tags. Which slots are content:

- Where the skeleton has an article or main element, the slots within it but for parts that say what they are (menu, header, footer, sidebar, notice,
  advert, form, comments). Pages may repeat passages of their articles, so a template text within them goes only if it is in MAIN_SHARE of at least MAIN_PAGES pages, and only while such texts
  are the smaller part of a page's content.
- Elsewhere, the slots that vary: a second pass over such hosts' pages sums each slot's text that is no template text, and how much of it is link text. The
  innermost element of the skeleton that holds BODY_SHARE of the varying text outside links, and is no single paragraph, is the body; but if that lacks the first main heading, where this varies, the body is the innermost
  element with this heading and HEADED_SHARE of the text, so that long comments do not take an article's place. The body's slots that vary and are not mostly links are content, again but for parts that say what they are.

Pages are then read along their host's skeleton and the texts of content slots are kept, without template texts.
Elements that pages repeat without a class, id or role of their own are told apart by their slot only.
Pages of hosts with fewer than MIN_PAGES pages and without such an element, and pages that lack their host's main element, are read by their own tags.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import cut, extended
from frostline.llm.url_filter import host_and_path

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|[^<]+|<",
    re.S | re.I,
)
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Elements without content, elements that do not end a block, and elements and names of parts that are not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
DROPPED = frozenset("head title nav header footer aside form button menu dialog".split())
PART_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus"
    " footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification popup promo"
    " promoted related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)


#: Words of class names that tell nothing about a part: 'related-work' is a part of a text, 'related-posts-box' is not.
NEUTRAL_NAMES = frozenset(
    "a area articles bar block bottom box button buttons col column container content fixed global group head holder icons inner item items left link links list"
    " main module outer page panel post posts primary region right row secondary section site slot stories sub text title top unit widget wrap wrapper".split()
)
#: Elements that hold one paragraph, heading or cell: none is a page's body.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption".split())
#: Pages that a host needs for its varying texts to tell slots apart; the share of that text outside links that the body holds.
MIN_PAGES = 3
BODY_SHARE = 0.7
HEADED_SHARE = 0.1
#: Pages of a host, and the share of them, in which a text within the main element must be to be the template's.
MAIN_PAGES, MAIN_SHARE = 10, 0.9
#: Bytes of all templates up to which they are broadcast (measured before); larger ones are joined.
MAX_BROADCAST = 64 << 20


#: The share of a host's pages with tags in which a tag occurs once to be in the skeleton; pages tried for the skeleton's order.
SHARE = 0.7
ORDERS = 8


def tokens(page: str | None) -> Iterator[tuple[str, str]]:
    """('tag', 'name class=.. id=..'), ('tag', '/' and what it closes) or ('text', decoded text), in page order.

    A closing tag has the role of the nearest open element of its name, which tells the ends of different parts apart.
    """
    path: list[str] = []
    is_open: dict[str, int] = {}
    for m in _TOKEN.finditer(page or ""):
        inner = m.group(2)
        if inner is None:
            if m.group(1) is None and not m.group(0).startswith(("<!", "<?")):
                yield "text", html.unescape(m.group(0))
            continue
        role = _role(inner)
        name = element(role)
        if role[0] != "/":
            if name not in VOID and not inner.endswith("/"):
                path.append(role)
                is_open[name] = is_open.get(name, 0) + 1
        elif is_open.get(name):
            while True:
                closed = path.pop()
                is_open[element(closed)] -= 1
                if element(closed) == name:
                    break
            role = "/" + closed
        yield "tag", role


def _role(inner: str) -> str:
    name = _NAME.match(inner).group(0).lower()
    if name[0] == "/" or len(inner) == len(name):
        return name
    return name + "".join(
        sorted(f" {k.lower()}={' '.join(sorted((a or b or c).lower().split()))}" for k, a, b, c in _MARKS.findall(inner))
    )


def element(tag: str) -> str:
    return tag.lstrip("/").split(" ", 1)[0]


@lru_cache(10_000)
def is_dropped(tag: str) -> bool:
    """Whether an opening tag starts a part that is not content, by its name or the words of its class, id and role."""
    name, _, marks = tag.partition(" ")
    if name in DROPPED:
        return True
    if name in ("html", "body"):
        return False
    names = [set(re.split(r"[-_]+", x)) - {""} for x in re.split(r"[\s=]+", marks) if x not in ("class", "id", "role")]
    return name not in MAIN and any(x & PART_NAMES and x <= PART_NAMES | NEUTRAL_NAMES for x in names)


def text_token(text: str) -> str | None:
    """A text's token: '#' and a hash of its words; None for white space."""
    from xxhash import xxh64_hexdigest

    words = " ".join(text.split())
    return "#" + xxh64_hexdigest(words.encode("utf-8", "surrogatepass")) if words else None


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, tag, n, first, last) of each page's tags and text tokens; tag '' stands for a page that has tags."""
    for b in batches:
        out: list[tuple] = []
        for i, page in enumerate(b.column(2)):
            seen: dict[str, list[int]] = {"": [1, 0, 0]}
            tags = False
            for at, (kind, x) in enumerate(tokens(page.as_py())):
                tags |= kind == "tag"
                if kind == "text" and (x := text_token(x)) is None:
                    continue
                s = seen.setdefault(x, [0, at, at])
                s[0] += 1
                s[2] = at
            if tags:
                out += [(i, t, *s) for t, s in seen.items()]
        row, tag, n, first, last = zip(*out) if out else ((), (), (), (), ())
        pick = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pick), b.column(1).take(pick), pa.array(tag, pa.string()), *(pa.array(x, pa.int64()) for x in (n, first, last))],
            names=["host", "page", "tag", "n", "first", "last"],
        )


def _seen_at(order: int):
    """The place in the page where the tag is, if it is there once, under a number by which the page is drawn."""
    page = F.xxhash64("page", F.lit(order)).bitwiseAND(F.lit(~0xFFFFFF))
    return F.when(F.col("n") == 1, page.bitwiseOR(F.least("first", F.lit(0xFFFFFF))))


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(host, n_pages, tag, in_pages, once, total, signature, first, last, at0, ..) from (host, page, html); tags of one host with the same in_pages,
    total and signature have the same occurrence vector. Text tokens are among them if two pages have them. n_pages are those that have tags; first and last sum the tag's places; once counts the
    pages that have the tag once, of which at0.. draw ORDERS and tell the tag's place."""
    counts = pages.select("host", "page", "html").mapInArrow(_token_counts, "host string, page long, tag string, n long, first long, last long")
    # sums wrap on purpose: a signature is a number modulo 2^64
    part = F.shiftright(F.xxhash64("page"), 16) * F.col("n")
    tags = counts.groupBy("host", "tag").agg(
        F.count("*").alias("in_pages"), F.count_if(F.col("n") == 1).alias("once"), F.sum("n").alias("total"),
        F.sum(part.cast("decimal(38,0)")).alias("signature"), F.sum("first").alias("first"), F.sum("last").alias("last"),
        *(F.min(_seen_at(k)).alias(f"at{k}") for k in range(ORDERS)),
    )
    tags = cut(tags.where(~F.col("tag").startswith("#") | (F.col("in_pages") > 1)))
    hosts = tags.where("tag = ''").select("host", F.col("total").alias("n_pages"))
    return tags.where("tag <> ''").join(hosts, "host")


def _skeletons(classes: DataFrame) -> DataFrame:
    """(host, n_pages, root): the skeleton's (place, first, tag) in page order, by that of the drawn pages that has most of its tags."""
    often = classes.where((F.col("once") >= SHARE * F.col("n_pages")) & ~F.col("tag").startswith("#"))
    drawn = often.select("host", "n_pages", "tag", (F.col("first") / F.col("in_pages")).alias("first"), F.posexplode(F.array(*(f"at{k}" for k in range(ORDERS)))).alias("k", "at"))
    page = F.shiftright("at", 24)
    roots = drawn.groupBy("host", "n_pages", "k", page.alias("drawn")).agg(
        F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFF)).alias("place"), "first", "tag"))).alias("root")
    )
    return roots.groupBy("host", "n_pages").agg(F.max_by("root", F.struct("c", "k", "drawn")).alias("root"))


def templates(classes: DataFrame) -> DataFrame:
    """One row per host: host, n_pages, skeleton (its tags in page order), nested (array of slot and tags for the other classes
    of which every tag lies in one slot on average), texts (tokens of the template texts), sure (those of them that count within a main element, too)."""
    is_text, often = F.col("tag").startswith("#"), F.col("once") >= SHARE * F.col("n_pages")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["tag"])
    roots = _skeletons(classes)
    vector = ["host", "in_pages", "total", "signature"]
    others = (
        classes.where(~often & ~is_text)
        .groupBy(*vector)
        .agg(ordered(F.struct("first", "tag")).alias("tags"), F.min(F.col("first") / F.col("in_pages")).alias("lo"), F.max(F.col("last") / F.col("in_pages")).alias("hi"))
    )
    slot = lambda x: F.size(F.filter("root", lambda r: r["first"] < x))
    placed = others.join(roots, "host").withColumn("slot", slot(F.col("lo"))).where(F.col("slot") == slot(F.col("hi")))
    nested = placed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "tags"))).alias("nested"))
    constant = classes.where(is_text & (F.col("in_pages") >= F.greatest(F.lit(MIN_PAGES), SHARE * F.col("n_pages"))))
    sure = F.when(F.col("in_pages") >= F.greatest(F.lit(MAIN_PAGES), MAIN_SHARE * F.col("n_pages")), F.col("tag")).alias("sure")
    in_root = constant.where(often).select("host", "tag", sure)
    in_nested = constant.where(~often).join(placed.select(*vector), vector, "left_semi").select("host", "tag", sure)
    texts = in_root.unionByName(in_nested).groupBy("host").agg(F.sort_array(F.collect_set("tag")).alias("texts"), F.sort_array(F.collect_set("sure")).alias("sure"))
    whole = roots.join(nested, "host", "left").join(texts, "host", "left")
    return whole.select("host", "n_pages", F.transform("root", lambda r: r["tag"]).alias("skeleton"), "nested", "texts", "sure")


class Template:
    """A host's skeleton with, for each tag, whether the slot after it is content.

    Only elements that the skeleton both opens and closes are in it; an open main element without an end lasts to the end of what holds
    it. Other tags are read within their slot, page by page.
    """

    def __init__(self, skeleton: list[str], texts: list[str] | None = None, slots: list[dict] | None = None):
        """texts: those that are left out; slots: (slot, chars, linked) of the texts that vary, of a host that is judged by them; without, article and main elements and the parts' names decide."""
        self.texts = frozenset(texts or ())
        path: list[int] = []
        valid: set[int] = set()
        for i, t in enumerate(skeleton):
            if t[0] != "/":
                if element(t) not in VOID:
                    path.append(i)
            elif any(skeleton[p] == t[1:] for p in path):
                valid.add(i)
                while (p := path.pop()) is not None:
                    if skeleton[p] == t[1:] or element(skeleton[p]) in MAIN:
                        valid.add(p)
                    if skeleton[p] == t[1:]:
                        break
        valid |= {p for p in path if element(skeleton[p]) in MAIN}
        tags = [t for i, t in enumerate(skeleton) if i in valid]
        self.at = {t: i for i, t in enumerate(tags)}
        self.has_main = any(element(t) in MAIN for t in tags)
        self.content = []
        inside: list[str] = []
        for t in tags:
            if t[0] != "/":
                inside.append(t)
            else:
                while inside.pop() != t[1:]:
                    pass
            main = not self.has_main or any(element(p) in MAIN for p in inside)
            self.content.append(main and not any(is_dropped(p) for p in inside))
        self.varying = slots is not None
        if self.varying:
            body = self._body(tags, {x["slot"]: x["chars"] - x["linked"] for x in slots})
            vary = {x["slot"] for x in slots if 2 * x["linked"] <= x["chars"]}
            self.content = [on and i in vary and i in body for i, on in enumerate(self.content)]

    @staticmethod
    def _body(tags: list[str], plain: dict[int, int]) -> range:
        """The slots of the innermost element that holds BODY_SHARE of the plain text by slot, or of the one about the heading that this lacks; all if none does."""
        before = [0]
        for i in range(len(tags)):
            before.append(before[-1] + plain.get(i, 0))
        spans, path = [range(len(tags))], []
        title = next((i for i, t in enumerate(tags) if element(t) == "h1" and t[0] != "/" and plain.get(i)), None)
        for i, t in enumerate(tags):
            if t[0] != "/":
                path.append(i)
                continue
            while tags[o := path.pop()] != t[1:]:
                pass
            if element(t) not in TEXT_LEVEL | INLINE:
                spans.append(range(o, i))
        held = lambda r: before[r.stop] - before[r.start]
        body = min((r for r in spans if held(r) >= BODY_SHARE * before[-1]), key=len)
        if title is None or title in body:
            return body
        return min((r for r in spans if title in r and held(r) - plain[title] >= HEADED_SHARE * before[-1]), key=len, default=body)

    def in_order(self, tags: list[tuple[int, str]]) -> dict[int, int]:
        """{place in the page: place in the skeleton} of the page's skeleton tags that keep the skeleton's order (the longest such run)."""
        seq = [(at, self.at[t]) for at, t in tags if t in self.at]
        ends: list[int] = []
        back = [-1] * len(seq)
        for k, (_, s) in enumerate(seq):
            lo, hi = 0, len(ends)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if seq[ends[mid]][1] < s else (lo, mid)
            back[k] = ends[lo - 1] if lo else -1
            ends[lo:lo + 1] = [k]
        keep, k = {}, ends[-1] if ends else -1
        while k >= 0:
            keep[seq[k][0]] = seq[k][1]
            k = back[k]
        return keep

    def marks(self, toks: list[tuple[str, str]]) -> dict[int, int]:
        """{place: slot} of the skeleton's tags in a page; a tag that the page repeats is read within its slot."""
        once: dict[str, int] = {}
        for kind, x in toks:
            if kind == "tag":
                once[x] = once.get(x, 0) + 1
        return self.in_order([(i, x) for i, (kind, x) in enumerate(toks) if kind == "tag" and once[x] == 1])

    def slot_texts(self, page: str | None, texts: frozenset[str]) -> dict[int, list[int]]:
        """{slot: [characters that are no template text, those of them in links]}."""
        toks, out, slot, links = list(tokens(page)), {}, -1, 0
        marks = self.marks(toks)
        for i, (kind, x) in enumerate(toks):
            if kind == "tag":
                links = max(0, links + (element(x) == "a") * (-1 if x[0] == "/" else 1))
                slot = marks.get(i, slot)
            elif (t := text_token(x)) and t not in texts:
                n = out.setdefault(slot, [0, 0])
                n[0] += len(x)
                n[1] += len(x) * (links > 0)
        return out

    def extract(self, page: str | None) -> str:
        toks = list(tokens(page))
        marks = self.marks(toks)
        own_main = self.varying and any(kind == "tag" and element(x) in MAIN for kind, x in toks)
        # a page that lacks the host's main element, or of a host that has none and was not judged by what varies, is read like a page of its own
        if own_main or not any(self.content[s] for s in marks.values()) or not (self.has_main or self.varying):
            return Template.own(toks).extract_tokens(toks)
        return self.extract_tokens(toks, marks)

    @staticmethod
    def own(toks: list[tuple[str, str]]) -> Template:
        once: dict[str, int] = {}
        for kind, x in toks:
            if kind == "tag":
                once[x] = once.get(x, 0) + 1
        return Template([x for kind, x in toks if kind == "tag" and once[x] == 1])

    def extract_tokens(self, toks: list[tuple[str, str]], marks: dict[int, int] | None = None) -> str:
        if marks is None:
            marks = self.in_order([(i, x) for i, (kind, x) in enumerate(toks) if kind == "tag"])
        on = not self.at  # without any skeleton the page is one slot
        path: list[str] = []  # what is open inside the slot
        skipped = 0
        out: list[str] = []
        repeated: list[int] = []  # places in out of template texts
        for i, (kind, x) in enumerate(toks):
            if kind == "text":
                if on and not skipped:
                    if self.texts and text_token(x) in self.texts:
                        repeated.append(len(out))
                    out.append(x)
                continue
            name = element(x)
            if name not in INLINE:
                out.append(" ")
            if i in marks:
                on, path, skipped = self.content[marks[i]], [], 0
            elif x[0] == "/":
                if any(element(p) == name for p in path):
                    while True:
                        p = path.pop()
                        skipped -= is_dropped(p)
                        if element(p) == name:
                            break
            elif name not in VOID:
                path.append(x)
                skipped += is_dropped(x)
        less = sum(len(out[i]) for i in repeated)
        if repeated and (self.varying or 2 * less < sum(map(len, out))):
            for i in repeated:
                out[i] = ""
        return " ".join("".join(out).split())


def _joined(pages: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """pages with their hosts' columns of found, which is broadcast up to a measured size; beyond it, an exchange of its own lets AQE choose and split."""
    chars = sum((F.coalesce(F.length(F.array_join(c, ",")), F.lit(0)) for c in ("skeleton", "texts")), F.lit(200)) + 32 * F.size("skeleton")
    if "slots" in columns:
        chars = chars + 64 * F.greatest(F.size("slots"), F.lit(0))
    size = found.agg(F.sum(chars)).first()[0] or 0
    side = found.select("host", *columns)
    return pages.join(F.broadcast(side) if 2 * size <= MAX_BROADCAST else side.repartition(F.xxhash64("host")), "host", "left")


def with_varying_slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """found (templates, cut) with slots (slot, chars, linked) of the skeleton's slots that hold varying text, for hosts of MIN_PAGES pages without an article or main element; else null."""
    no_main = ~F.exists("skeleton", lambda t: F.substring_index(t, " ", 1).isin(*sorted(MAIN)))
    judged = found.where(no_main & (F.col("n_pages") >= MIN_PAGES)).select("host", "n_pages", "skeleton", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, int], list[int]] = {}
            known: dict[str, tuple[Template, frozenset[str]]] = {}
            for host, page, skeleton, texts in zip(*b.columns):
                if (h := host.as_py()) not in known:
                    known[h] = Template(skeleton.as_py()), frozenset(texts.as_py() or ())
                for slot, n in known[h][0].slot_texts(page.as_py(), known[h][1]).items():
                    t = total.setdefault((h, slot), [0, 0])
                    t[0], t[1] = t[0] + n[0], t[1] + n[1]
            rows = [(h, slot, *n) for (h, slot), n in total.items()]
            host, slot, chars, linked = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in (slot, chars, linked))], names=["host", "slot", "chars", "linked"])

    if judged.isEmpty():
        return found.withColumn("slots", F.lit(None).cast("array<struct<slot: bigint, chars: bigint, linked: bigint>>"))
    own = _joined(pages.select("host", "html"), judged, "skeleton", "texts").where("skeleton is not null").select("host", "html", "skeleton", "texts")
    slots = own.mapInArrow(run, "host string, slot long, chars long, linked long").groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    # a row per tag of the host's skeleton at most
    by_host = slots.where("slot >= 0").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "chars", "linked"))).alias("slots"))
    return found.join(by_host, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Pages are grouped by the host of their url; those without one are a group, too. A null or empty page and one without content
    have an empty text. Null ids and repeated rows stay, and equal pages of a host have equal texts; of skeletons that are as common the one drawn by the page of least hash is taken; a very long page is read whole; no rows give no rows; other columns are not read.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_and_path(url)[0].alias("host"), F.col(html_col).cast("string").alias("html"))
    keyed = rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    found = with_varying_slots(rows, cut(templates(equivalence_classes(keyed))))
    found = cut(found.withColumn("texts", F.when(F.col("slots").isNull(), F.col("sure")).otherwise(F.col("texts"))).drop("nested", "sure"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in batches:
            out = []
            for host, page, skeleton, texts, slots in zip(*b.columns[2:]):
                key = host.as_py()
                if key not in known:
                    if len(known) > 500:
                        known.clear()
                    known[key] = Template(skeleton.as_py() or [], texts.as_py(), slots.as_py())
                out.append(known[key].extract(page.as_py()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    joined = _joined(rows, found, "skeleton", "texts", "slots").select("page_id", "url", "host", "html", "skeleton", "texts", "slots")
    return joined.mapInArrow(run, extended(rows.select("page_id", "url"), "text string")).withColumn("n_chars", F.length("text").cast("long"))
