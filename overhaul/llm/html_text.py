"""Main text of web pages by template deduction over the pages of a host.

Tokens are the tag paths of a page (element names with class and id, from the
root) and the words of each block at their path, a block's words being one
token. How often a token occurs, and on how many pages, is added up by host
before and after the shuffle, so no host's pages meet in one task. The class of
tokens that occur once on every page are the host's template. Words that stand
at the same path on nearly all pages are boilerplate, and so is all else that
lies directly at a place of the template with such words; all that
the template leaves variable, every slot with its headings, is the text. Named
parts (menus, notices and the like) are left out of it, but by their class or id
only if they enclose no article and not most of the host's text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import map_batches, stage
from overhaul.llm.urls import host_and_path

HOLDS = 0.8  # share of a host's pages on which a text must be the same to be the template's
LEAST_PAGES = 3  # different pages of a host, below which it has no template
MOST = 0.5  # an element with more of the text is no boilerplate for its class or id alone
PAGE = 0  # the token of a page itself

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Raw elements: their content is no text. An unclosed one of the first kind ends with the page, as in
# browsers; an unclosed one of the second kind hides nothing.
RAW_TO_END = frozenset("script style textarea title iframe noscript".split())
RAW = RAW_TO_END | frozenset("template svg object canvas select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split())
# Elements that a start tag of the same kind, or of any block, ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
LEFT_OUT = frozenset("nav header footer aside form dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Words in a class or id that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie"
    r"|cookies|disqus|footer|header|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|pager"
    r"|popup|promo|promoted|recommended|related|reply|replies|respond|share|sharing|sidebar|sidebars|social|sponsor|sponsored"
    r"|subscribe|toolbar|widget|widgets)(?:$|[-_ ])", re.I)
# Where markup may begin, and a tag; its quoted values may hold ">". Possessive: a tag that fails does so in one pass.
START = re.compile(r"<!--|<[!?]|</?[a-zA-Z]")
TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WHITE = re.compile(r"\s+")


def _tags(page: str):
    """Start, tag (None for comments and declarations) and where the text goes on, for all markup outside raw elements.

    Linear in the page: a tag whose quotes do not close before the page ends is taken to its first ">" like all tags
    after it, and where no ">" follows no markup does.
    """
    at, unclosed, tag = 0, set(), TAG
    while begun := START.search(page, at):
        start = begun.start()
        if begun[0] == "<!--":
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, None, at
            continue
        if begun[0][-1] in "!?":
            m, end = None, page.find(">", start)
        else:
            m = tag.match(page, start)
            if not m and tag is TAG:
                tag = PLAIN_TAG
                m = tag.match(page, start)
            end = m.end() - 1 if m else -1
        if end < 0:
            return
        at = end + 1
        if m:
            name = m["name"].lower()
            if name in RAW and not m["end"] and not m["rest"].endswith("/") and name not in unclosed:
                if (close := RAW_END[name].search(page, at)) and (end := page.find(">", close.end())) >= 0:
                    at = end + 1
                elif name in RAW_TO_END:
                    at = len(page)
                else:
                    unclosed.add(name)
        yield start, m, at


@lru_cache(maxsize=4096)
def _element(name: str, rest: str) -> tuple[str, str]:
    """An element's name in paths, and what speaks for leaving it out: head, part, only a hint, or nothing ("")."""
    name, path, hint = name.lower(), name.lower(), name.lower() == "form"
    out = name in LEFT_OUT and not hint
    if rest.strip(" /\n\t"):
        for m in ATTRIBUTE.finditer(re.sub(r"(?<![\w-])(?!class|id|role|hidden|aria-hidden)[\w:-]+\s*=\s*(\"[^\"]*\"|'[^']*')", " ", rest, flags=re.I)):
            key, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
            if key in ("class", "id"):
                hint |= name not in ("html", "body", "article", "main") and bool(MARKS.search(value))
                path += f".{value}" if key == "class" else f"#{value}" if not any(map(str.isdigit, value)) else ""
            elif key == "role":
                hint |= value.lower() == "form"
                out |= value.lower() in ROLES - {"form"}
            else:
                out |= key == "hidden" or value.lower() == "true"
    return path, "head" if name == "head" else "part" if out else "hint" if hint else ""


def blocks(page: str):
    """The blocks of a page outside the head, as (path, parts), the count of every tag path, and what may be left out.

    A block is text between block tags; its parts are (marks, text), where the
    marks are the numbers of the enclosing elements that may be left out. Of
    each such element comes its path, whether an article or main lies in it,
    and whether only its class, its id or its being a form speaks against it.
    """
    stack: list[tuple[str, str, tuple[int, ...] | None]] = []  # name, path, marks; None in the head
    counts: dict[str, int] = {}
    found: list[tuple[str, list[tuple[tuple[int, ...], str]]]] = []
    marked: list[list] = []
    pending: list[tuple[tuple[int, ...], str]] = []
    at = 0

    def flush():
        if pending:
            if any(text.strip() for _, text in pending):
                found.append((stack[-1][1] if stack else "", pending.copy()))
            pending.clear()

    def close(to: int):
        flush()
        del stack[to:]

    def add(text: str):
        marks = stack[-1][2] if stack else ()
        if marks is None:
            return
        if pending and pending[-1][0] == marks:
            pending[-1] = marks, pending[-1][1] + text
        else:
            pending.append((marks, text))

    def marks_of(path: str, out: str):
        marks = stack[-1][2] if stack else ()
        if not out or marks is None:
            return marks
        if out == "head":
            return None
        marked.append([path, False, out == "hint"])
        return (*marks, len(marked) - 1)

    for start, m, then in _tags(page):
        if start > at:
            add(page[at:start])
        at = then
        if m is None:
            continue
        name = m["name"].lower()
        if name in RAW and not m["end"] and (then > m.end() or name in RAW_TO_END or m["rest"].endswith("/")):
            add(" ")
            continue
        if name in INLINE:
            # Inline elements do not nest the path; a left-out one hides its text.
            if m["end"]:
                if stack and stack[-1][0] == name:
                    stack.pop()
            elif name == "br":
                add(" ")
            elif name not in VOID and m["rest"]:
                label, out = _element(name, m["rest"])
                if out:
                    path = stack[-1][1] if stack else ""
                    stack.append((name, path, marks_of(_below(path, label), out)))
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                flush()
            continue
        ends = ENDS.get(name, ())
        if stack and (stack[-1][0] == "p" or stack[-1][0] in ends):
            close(len(stack) - 1)
        else:
            flush()
        if name in VOID:
            continue
        label, out = _element(name, m["rest"])
        path = _below(stack[-1][1], label) if stack else label
        counts[path] = counts.get(path, 0) + 1
        if name in ("article", "main") and stack:
            for k in stack[-1][2] or ():
                marked[k][1] = True
        if not m["rest"].endswith("/"):
            stack.append((name, path, marks_of(path, out)))
    if at < len(page):
        add(page[at:])
    flush()
    return found, counts, marked


def _words(parts) -> str:
    return WHITE.sub(" ", html.unescape("".join(text for _, text in parts))).strip()


def _below(path: str, label: str) -> str:
    """The path of an element: its own label after a hash of all that it lies in, so depth does not make it longer."""
    return f"{_hash(path):x}/{label}"


def _sizes(found, counts, marked) -> tuple[int, dict[str, int]]:
    """The text of a page without article and main, and the text in each path that only a hint speaks against."""
    if any(re.match(r"(article|main)\b", path.rpartition("/")[2]) for path in counts):
        return 0, {}
    whole, sizes = 0, {}
    for _, parts in found:
        for marks, text in parts:
            if all(marked[k][2] for k in marks):
                size = len(text.strip())
                whole += size
                for path in {marked[k][0] for k in marks}:
                    sizes[path] = sizes.get(path, 0) + size
    return whole, sizes


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - 2**63


def _holding(sizes: dict[str, int], whole: int) -> set[int]:
    return {_hash(path) for path, size in sizes.items() if size > MOST * whole}


def main_text(page: str, template: tuple[frozenset[int], frozenset[int]] | None) -> str:
    """Text of all blocks but the parts left out and those that the template (drop, keep) drops.

    If that would leave none, the page is judged by itself. An element is not
    left out if an article or main lies in it; without these on the page, a
    hint leaves none out that holds most of the host's text.
    """
    found, counts, marked = blocks(page)
    whole, sizes = _sizes(found, counts, marked)
    for drop, keep in [*([template] if template else []), (frozenset(), _holding(sizes, whole))]:
        stays = [main or (hint and whole > 0 and _hash(path) in keep) for path, main, hint in marked]
        texts = [_words([p for p in parts if all(stays[k] for k in p[0])]) for path, parts in found
                 if not drop or _hash(path) not in drop and _hash(f"{path}\0{_words(parts)}") not in drop]
        if any(texts):
            return "\n".join(text for text in texts if text)
    return ""


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, place, pages, n, size: how many pages a token is on, how often, and the text in it, summed over each batch.

    Tokens: the page itself (PAGE), each path that blocks lie at or that may be
    left out, and each block's words at their path, which is the token's place.
    A page counts by its weight; sizes are summed where no article or main is.
    """

    def run(batches):
        for b in batches:
            sums: dict[tuple[str, int, int | None], list[float]] = {}
            for host, page, weight in zip(*(b.column(c).to_pylist() for c in ("host", "html", "weight"))):
                found, counts, marked = blocks(page)
                whole, sizes = _sizes(found, counts, marked)
                places = {path: _hash(path) for path in {path for path, _ in found} | sizes.keys()}
                tokens = {(PAGE, None): (1, whole)}
                tokens.update(((places[path], None), (counts.get(path, 1), sizes.get(path, 0))) for path in places)
                for path, parts in found:
                    key = _hash(f"{path}\0{_words(parts)}"), places[path]
                    tokens[key] = tokens.get(key, (0, 0))[0] + 1, 0
                for (token, place), (n, size) in tokens.items():
                    s = sums.setdefault((host, token, place), [0.0, 0.0, 0.0])
                    s[0] += weight
                    s[1] += weight * n
                    s[2] += weight * size
            rows = [(*key, *s) for key, s in sums.items()]
            names = ("host", "token", "place", "pages", "n", "size")
            yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    return map_batches(pages, run, "host string, token long, place long, pages double, n double, size double")


def dropped(members: list[dict], n_pages: float) -> list[int]:
    """What a template of ``n_pages`` pages drops, of its tokens (token, place, pages, n) on nearly all pages."""
    members = [m for m in members if m["pages"] >= HOLDS * n_pages - 1e-6]
    each = n_pages - 1e-6
    once = {m["token"] for m in members if m["place"] is None and m["pages"] >= each and m["n"] <= n_pages + 1e-6}
    words = [m for m in members if m["place"] is not None]
    return sorted({m["token"] for m in words} | {m["place"] for m in words if m["place"] in once})


def templates(pages: DataFrame) -> DataFrame:
    """host, drop, keep: what each host's template drops, and what no hint leaves out (pages: host, key, html).

    Hosts with too few pages have no template.
    """
    # Repeated pages say nothing about a template: together they count as one.
    copies = stage(pages.groupBy("host", "key").count().where("count > 1"), "copies")
    weighted = pages.join(copies, ["host", "key"], "left").select(
        "host", "html", (F.lit(1.0) / F.coalesce("count", F.lit(1))).alias("weight"))
    sums = occurrences(weighted).groupBy("host", "token", "place").agg(*(F.sum(n).alias(n) for n in ("pages", "n", "size")))
    # An element on few pages can hold most of the text, words on few pages are not the template's.
    tokens = stage(sums.where((F.col("pages") > LEAST_PAGES - 0.5) | (F.col("size") > 0)), "tokens")
    whole = tokens.where((F.col("token") == PAGE) & F.col("place").isNull() & (F.col("pages") > LEAST_PAGES - 0.5)).select(
        "host", F.col("pages").alias("n_pages"), F.col("size").alias("whole"))
    members = tokens.where((F.col("token") != PAGE) | F.col("place").isNotNull()).join(whole, "host").where(
        (F.col("pages") >= HOLDS * F.col("n_pages") - 1e-6) | (F.col("size") > MOST * F.col("whole")))
    members = members.groupBy("host").agg(F.first("n_pages").alias("n_pages"), F.first("whole").alias("whole"), F.collect_list(
        F.struct("token", "place", "pages", "n", "size")).alias("members"))  # no longer than some pages

    def run(batches):
        for b in batches:
            ms, n, whole = (b.column(c).to_pylist() for c in ("members", "n_pages", "whole"))
            yield {"host": b.column("host"), "drop": [dropped(m, k) for m, k in zip(ms, n)],
                   "keep": [[x["token"] for x in m if x["size"] > MOST * w] for m, w in zip(ms, whole)]}

    return map_batches(members, run, "host string, drop array<long>, keep array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page: its main text, blocks joined by a line feed.

    Null html is empty and gives an empty text; a null url has the empty host,
    whose pages share a template; null page_ids are carried; repeated rows are
    extracted each. Other columns are ignored, whatever their names; an empty
    table gives an empty table.
    """
    host, _ = host_and_path(F.col("url"))
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    found = stage(templates(own.select("host", F.xxhash64("html").alias("key"), "html")), "templates")

    def run(batches):
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("html", "drop", "keep"))
            texts = [main_text(p, None if d is None else (frozenset(d), frozenset(k))) for p, d, k in zip(*columns)]
            yield {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts}

    joined = own.join(found, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "drop", "keep")
    return map_batches(joined, run, "page_id long, url string, text string")
