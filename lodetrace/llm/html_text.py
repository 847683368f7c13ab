"""Main text of web pages by a suffix array over a host's pages, with the marks of elements for what repetition can't tell.

A page is read into blocks, and its stream is the tokens of all its blocks, the article's included. The streams of a host's
pages are put end to end and their suffixes sorted; neighbours in that order whose longest common prefix is RUN tokens
or more, and which lie on different pages, are a repeated run and cover its places. Then, for each block:

- one that lies in an article (or main) element and in nothing marked is the article's and stays, however often it is
  repeated: articles are copied and quoted on a host. So only runs that touch another block are looked for;
- of the others, one mostly covered goes as repeated, but for unique runs of RUN tokens or more in it, and one that isn't goes if it lies in an
  element that says it is a menu, header, footer, sidebar, notice, advert, form or reader comment. A form, dialog, search box or the like that
  holds an article, or most of the page's text that isn't marked otherwise, is no such element;
- what is left, neither in an article nor repeated nor marked, stays, unless articles hold most of the text that stays; headings and
  paragraphs right before an article stay always.

Pages with the same unmarked text are copies and count as one page. Of a host too large for one array, the
suffixes are dealt by the hash of their first RUN tokens and sorted within each part, which gives the same runs.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import slices, table, written
from lodetrace.llm.minhash import _groups as groups_of
from lodetrace.llm.minhash import mix, word_hashes

DOUBLINGS = 3
RUN = 2**DOUBLINGS
COVERED = 0.5
HOST_CHARS = 1 << 19
PAGE_CHARS = 256
HOST_BYTES = 128

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|math|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<tag>/?[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<open_quote>/?[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
APART = frozenset("br td th img input select button".split())
CLOSES_P = BLOCK - {"html", "body", "head", "caption", "legend", "tbody", "thead", "tfoot", "tr", "option", "optgroup"}
#: Opening one of these ends an open one of the same set that lies above the tag's container.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
CONTAINERS = frozenset("ul ol dl table select article section div main nav aside header footer form blockquote body".split())
DROPPED_TAGS = frozenset("nav header footer aside form button select menu dialog head fieldset object canvas audio video".split())
#: Names (classes, ids, roles) that say what an element is, as a whole.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search comment comments "
    "disqus respond share sharing social related recommended pagination pager widget toolbar complementary contentinfo alert".split())
#: Marks that an article element inside doesn't lift. They also tell as the first word of a name whose other words are of layout, as in ad-slot.
FIRM = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion comment comments disqus respond related recommended cookie cookies newsletter".split())
LAYOUT = frozenset(
    "slot box container wrapper wrap unit block area banner list section item items body form posts links content widget bar top bottom left right side inner outer frame zone "
    "label module panel row col holder space thread".split())
#: What may also be wrapped around a page's text.
SOFT_TAGS = frozenset("form fieldset object dialog".split())
SOFT_NAMES = frozenset("search widget banner header masthead popup modal overlay toolbar subscribe subscription signup login alert contentinfo".split())
LEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MENU_WORDS = 3
MAIN, UNSURE, MARKED, LEAD = 0, 1, 2, 3


def _marks(attrs: str) -> tuple[set[str], bool]:
    """The telling names of class, id and role, and whether the role is main."""
    names, main = set(), False
    if "=" in attrs:
        for name, a, b, c in NAMED.findall(attrs):
            value = a or b or c
            main |= name.lower() == "role" and value.lower() == "main"
            for one in value.split():
                words = [w.lower() for w in WORDS.findall(one)]
                if one.lower() in DROPPED_NAMES:
                    names.add(one.lower())
                elif words and words[0] in FIRM and all(w in LAYOUT or w.isdigit() for w in words[1:]):
                    names.add(words[0])
    return names, main


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block that isn't empty, in page order.

    If an article element holds text, what is in one is MAIN, else what is in a main element. MARKED is what lies in an element that says
    it isn't main text, and a list's item outside articles that is a link of few words; LEAD are headings and paragraphs right before
    the first MAIN block; UNSURE is the rest.
    """
    out: list[list] = []  # marked, text, region, soft elements, tag
    stack: list[tuple[str, bool, bool, str, tuple]] = []  # tag, dropped, firmly, region, soft elements
    parts: list[str] = []
    linked = [0]
    n_soft, held = 0, set()

    def state():
        return stack[-1][1:] if stack else (False, False, "", ())

    def flush():
        text = SPACE.sub(" ", "".join(parts)).strip(" ")
        if text:
            dropped, _, region, soft = state()
            menu = not region and linked[0] >= len(text) and text.count(" ") < MENU_WORDS and any(e[0] in ("ul", "ol") for e in stack)
            tag = next((e[0] for e in reversed(stack) if e[0] in BLOCK), "")
            out.append([dropped or menu, text, "" if dropped else region, soft, tag])
        parts.clear()
        linked[0] = 0

    def add(raw: str):
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(s[0] == "a" for s in stack):
                linked[0] += len(text)

    def pop_to(k: int):
        above = stack[k - 1] if k else ("", False, False, "", ())
        if any(s[0] in BLOCK for s in stack[k:]) or stack[k][1] != above[1] or stack[k][4] != above[4]:
            flush()
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag, attrs = m["tag"] or m["open_quote"], m["attrs"] or ""
        if tag is None:
            continue
        tag = tag.lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag in BLOCK and tag != "p":
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in CONTAINERS and stack[k][0] in CONTAINERS:
                    break
            if tag == "p":
                flush()
            elif tag in APART:
                parts.append(" ")
            continue
        if tag in APART:
            parts.append(" ")
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        ends = set(ENDED_BY.get(tag, ())) | ({"p"} if tag in CLOSES_P else set())
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in CONTAINERS:
                    break
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        dropped, firm, region, soft = state()
        marks, main = _marks(attrs) if tag not in ("html", "body") else (set(), False)
        if tag in ("article", "main") or main:
            if not firm and not marks & FIRM and not any(s[0] in DROPPED_TAGS and s[0] not in SOFT_TAGS for s in stack):
                held.update(soft)
                dropped, soft, region = False, (), "article" if tag == "article" or region == "article" else "main"
            else:
                dropped = True
        elif tag in SOFT_TAGS or marks and marks <= SOFT_NAMES and tag not in DROPPED_TAGS:
            if tag not in BLOCK:
                flush()
            n_soft, soft = n_soft + 1, (*soft, n_soft)
        elif tag in DROPPED_TAGS or marks:
            if not dropped and tag not in BLOCK:
                flush()
            dropped = True
        firm |= bool(marks & FIRM)
        stack.append((tag, dropped, firm, region, soft))
    add(page[at:])
    flush()
    total, inside = 0, {}
    for marked, text, _, soft, _ in out:
        if not marked:
            total += len(text)
            for k in soft:
                inside[k] = inside.get(k, 0) + len(text)
    # A soft element is no form or box if it holds an article, or most of the text that nothing else marks.
    open_ = held | {k for k, n in inside.items() if 2 * n > total}
    kinds = [MARKED if b[0] or any(k not in open_ for k in b[3]) else UNSURE for b in out]
    for region in ("article", "main"):
        wanted = ("article",) if region == "article" else ("main", "article")
        if any(b[2] == region and kind != MARKED for b, kind in zip(out, kinds)):
            kinds = [MAIN if b[2] in wanted and kind != MARKED else kind for b, kind in zip(out, kinds)]
            at = kinds.index(MAIN) - 1
            while at >= 0 and kinds[at] == UNSURE and out[at][4] in LEADS:
                kinds[at] = LEAD
                at -= 1
            break
    return [(kind, b[1]) for kind, b in zip(kinds, out)]


def suffix_order(flat: np.ndarray, doublings: int = DOUBLINGS) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of flat in the order of their first 2**doublings tokens, and for each after the first whether it has these in common with the one before.

    Ranks by ever longer prefixes, two of the last length making one of twice the length.
    """
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    for k in range(doublings):
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - 2**k)] = rank[2**k :] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    return order, np.diff(rank[order]) == 0


def covered_tokens(streams: list[np.ndarray], doublings: int = DOUBLINGS, owners: np.ndarray | None = None, outer: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Which tokens of each stream lie in a run of at least 2**doublings tokens that another stream has too.

    With owners (a number from 0 of each stream), the other stream must have another owner; with outer (booleans, a token each), runs
    must have an outer token in both places. Longer runs are unions of these.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    if not sizes.sum():
        return [np.zeros(n, bool) for n in sizes]
    page = np.repeat(np.arange(len(streams)) if owners is None else owners, sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(page), bool)
    inner[ends] = False
    flat = np.zeros(len(page), np.int64)
    flat[inner] = np.unique(np.concatenate([s for s in streams if len(s)]), return_inverse=True)[1]
    flat[ends] = flat.max() + 1 + np.arange(len(streams))  # the end of each stream is unlike anything else
    order, common = suffix_order(flat, doublings)
    if outer is not None:
        counts = np.zeros(len(page) + 2**doublings, np.int64)
        counts[np.flatnonzero(inner)] = np.concatenate(outer)
        counts = np.concatenate([[0], np.cumsum(counts)])
        touch = (counts[2**doublings :] > counts[: -(2**doublings)])[order]
        # Those that don't touch one are taken out of the order; what is between two of the same beginning is of it too.
        group = np.cumsum(np.r_[False, ~common])[touch]
        order, common = order[touch], np.diff(group) == 0
        if not len(order):
            return [np.zeros(n, bool) for n in sizes]
    begins = np.flatnonzero(np.r_[True, ~common])  # of stretches of suffixes that begin alike
    lo, hi = np.minimum.reduceat(page[order], begins), np.maximum.reduceat(page[order], begins)
    shared = np.repeat(lo < hi, np.diff(np.r_[begins, len(order)]))
    steps = np.zeros(len(page) + 1, np.int64)
    starts = order[shared]
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + 2**doublings, len(page)), -1)
    hit = np.cumsum(steps[:-1]) > 0
    return [hit[e - n : e] for e, n in zip(ends, sizes)]


def unique_runs(text: str, hit: np.ndarray) -> str:
    """What is left of a block without its repeated runs: the stretches of RUN tokens or more that lie in none."""
    words = text.split(" ")
    edges = np.flatnonzero(np.diff(np.r_[True, hit, True].astype(np.int8)))
    return " ".join(" ".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2]) if b - a >= RUN)


def main_text(kinds, texts, hits: list[np.ndarray]) -> tuple[str, int, int]:
    """The text that stays of a page's blocks, and how many went as repeated and as marked. hits says of each block's tokens whether they lie in repeated runs."""
    repeated = [kind != MAIN and len(h) > 0 and h.mean() >= COVERED for kind, h in zip(kinds, hits)]
    marked = [kind == MARKED and not r for kind, r in zip(kinds, repeated)]
    left = [unique_runs(t, h) if r and kind in (UNSURE, LEAD) else t for kind, t, r, h in zip(kinds, texts, repeated, hits)]
    article = [t for kind, t in zip(kinds, left) if kind == MAIN]
    others = [t for kind, t in zip(kinds, left) if kind == UNSURE]
    alone = sum(map(len, article)) > sum(map(len, others))
    kept = [t for kind, t in zip(kinds, left) if t and (kind in (MAIN, LEAD) or kind == UNSURE and not alone)]
    return "\n".join(kept), sum(repeated), sum(marked)


def _parsed(batches):
    """page_id, url, host, html to page_id, url, host, same (of the unmarked text), kinds, texts."""
    for batch in slices(batches):
        same, kinds, texts = [], [], []
        for page in batch.column(3).to_pylist():
            found = blocks(page or "")
            kinds.append([b[0] for b in found])
            texts.append([b[1].encode("utf-8", "replace").decode() for b in found])
            same.append(xxhash.xxh3_64_intdigest("\n".join(t for kind, t in found if kind != MARKED).encode("utf-8", "replace")) - 2**63)
        cols = [pa.array(same, pa.int64()), pa.array(kinds, pa.list_(pa.int8())), pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *cols], ["page_id", "url", "host", "same", "kinds", "texts"])


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a page's blocks end to end, and the number of each block's."""
    return word_hashes([t.encode() for t in texts]) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _by_block(hit: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(hit, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _rows(ids, urls, found):
    texts = [f[0] for f in found]
    return pa.RecordBatch.from_arrays(
        [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())],
        ["page_id", "url", "text", "n_chars", "n_repeated", "n_marked"])


def _host_texts(id_type: pa.DataType, url_type: pa.DataType):
    """Rows (host, same, page_id, url, kinds, texts), those of a host together, to the rows of extract: one suffix array a host."""

    def run(batches):
        for _, rows in groups_of(batches, 1):
            names: dict[int, int] = {}
            owners = np.array([names.setdefault(r[0], len(names)) for r in rows])
            tokens = [_tokens(r[4]) for r in rows]
            outer = [np.repeat(np.array(r[3], np.int8) != MAIN, sizes) for r, (_, sizes) in zip(rows, tokens)]
            hits = covered_tokens([t[0] for t in tokens], owners=owners, outer=outer)
            found = [main_text(r[3], r[4], _by_block(hit, sizes)) for r, (_, sizes), hit in zip(rows, tokens, hits)]
            yield from slices([_rows(pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], url_type), found)])

    return run


def _runs(batches):
    """Rows (uid, host, same, kinds, texts) to uid, host, same, starts and runs: places and hashes of the runs that touch a block outside the article."""
    for batch in slices(batches, 128):
        out = []
        for kinds, texts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            x, sizes = _tokens(texts)
            h = np.zeros(max(0, len(x) - RUN + 1), np.uint64)
            for i in range(RUN):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + len(h)])
            outside = np.concatenate([[0], np.cumsum(np.repeat(np.array(kinds, np.int8) != MAIN, sizes))])
            touch = outside[RUN : RUN + len(h)] > outside[: len(h)]
            out.append((np.flatnonzero(touch), h[touch].view(np.int64)))
        lists = [pa.array([o[i] for o in out], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *lists], ["uid", "host", "same", "starts", "runs"])


def _repeated_in_large(parsed: DataFrame, max_broadcast_mb: float) -> DataFrame:
    """uid, starts: the places at which repeated runs begin, on pages of large hosts. Suffixes are dealt by the hash of their first RUN tokens."""
    runs = parsed.select("uid", "host", "same", "kinds", "texts").mapInArrow(_runs, "uid long, host string, same long, starts array<int>, runs array<long>")
    runs = written(runs, "runs")
    each = runs.select("host", "same", F.explode(F.array_distinct("runs")).alias("run"))
    shared = each.groupBy("host", "run").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select("host", "run")
    shared = written(shared, "shared")
    shared = F.broadcast(shared) if shared.count() * HOST_BYTES <= max_broadcast_mb * 1e6 else shared
    at = runs.select("uid", "host", F.explode(F.arrays_zip("starts", "runs")).alias("r")).select("uid", "host", F.col("r.starts").alias("start"), F.col("r.runs").alias("run"))
    return at.join(shared, ["host", "run"]).groupBy("uid").agg(F.collect_list("start").alias("starts"))


def _page_texts(batches):
    """Rows (page_id, url, kinds, texts, starts) to the rows of extract."""
    for batch in slices(batches, 128):
        found = []
        for kinds, texts, starts in zip(*[batch.column(i).to_pylist() for i in range(2, 5)]):
            _, sizes = _tokens(texts)
            hit = np.zeros(int(sizes.sum()), bool)
            for i in range(RUN):
                hit[np.array(starts or [], np.int64) + i] = True
            found.append(main_text(kinds, texts, _by_block(hit, sizes)))
        yield _rows(batch.column(0), batch.column(1), found)


def extract(pages: DataFrame, host_chars: int = HOST_CHARS, max_broadcast_mb: float = 32) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated, n_marked of each row of (page_id, url, html); other columns are ignored.

    n_repeated and n_marked count the blocks that went because they are repeated on the host, and because of their marks alone.
    Null, empty and blank pages have an empty text. Repeated rows are copies of a page and each has its row. The
    suffixes of a host of more than ``host_chars`` characters of html, each page counting PAGE_CHARS more, are dealt over tasks, with the same result; a null url or one
    without a host has the host "".
    """
    kinds = dict(pages.dtypes)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#\s]*@)?([^/?#\s]*)", 1))
    sized = pages.groupBy(host.alias("_host")).agg(F.sum(F.coalesce(F.length("html"), F.lit(0)) + PAGE_CHARS).alias("n")).where(F.col("n") > host_chars).select("_host")
    sized = written(sized, "hosts")
    n_large = sized.count()
    sized = F.broadcast(sized) if n_large * HOST_BYTES <= max_broadcast_mb * 1e6 else sized
    named = pages.select("page_id", "url", "html", host.alias("_host"))
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, host string, same long, kinds array<byte>, texts array<string>"
    small = (named.join(sized, "_host", "left_anti") if n_large else named).select("page_id", "url", "_host", "html").mapInArrow(_parsed, schema)
    small = small.select("host", "same", "page_id", "url", "kinds", "texts").repartition("host").sortWithinPartitions("host")
    out = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_repeated int, n_marked int"
    arrow = pages.select("page_id", "url").limit(0).toArrow().schema
    texts = small.mapInArrow(_host_texts(arrow.field(0).type, arrow.field(1).type), out)
    if not n_large:
        return texts
    parsed = named.join(sized, "_host", "left_semi").select("page_id", "url", "_host", "html").mapInArrow(_parsed, schema)
    parsed = written(parsed.withColumn("uid", F.monotonically_increasing_id()), "parsed")
    hits = written(_repeated_in_large(parsed, max_broadcast_mb), "hits")
    n = hits.agg(F.sum(F.size("starts") * 4 + 24)).first()[0] or 0
    hits = F.broadcast(hits) if n <= max_broadcast_mb * 1e6 else hits
    rows = parsed.join(hits, "uid", "left").select("page_id", "url", "kinds", "texts", "starts")
    return texts.unionByName(rows.mapInArrow(_page_texts, out))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated, n_marked of every page: the main text, and how many blocks went by repetition and by marks."""
    return extract(table(spark, sf_dir, "pages"))
