"""Main text of HTML pages by equivalence-class template deduction.

1. Every page is read as a sequence of tokens: tags with their place in the document, and text nodes with
   theirs. For each token of a host, Spark adds up the pages it is on, its occurrences, and a fingerprint of
   its occurrence vector (an XOR over pages of a hash of page and count), all of them map-side.
2. Tokens of a host with the same vector form an equivalence class, if it is frequent (on at least half the
   pages) and holds tags.
3. A class has to be ordered: its tokens follow each other in one order, as often as the class occurs. Tokens
   that change places are taken out of it. Classes have to be nested: every occurrence of one lies in the same
   gap between two tokens of the other, or outside. Of two that are not, the one on fewer pages goes.
   Ordered and nested classes are the host's template; their text nodes are furniture.
4. A page's remaining text nodes, and all of its article, fill the template's slots. Slots inside menus, headers, footers,
   side columns, adverts, forms and the like are not main text; of the others, those of the article are
   taken if there is one.

A host with few pages, or with pages that are copies of each other, tells nothing about its
template; its pages are read by structure alone.
"""

import hashlib
import html as html_entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from wareloom.llm.common import run_tables
from wareloom.llm.url_rules import url_host_path

# A template is deduced for hosts of at least so many pages, half of which have text of their own.
MIN_PAGES = 8
FLUSH = 200_000

_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
# A tag whose quoted values may hold the sign that ends it, and one that ends at the first such sign.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
# One attribute with its value, so that nothing is found inside another's.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

# Elements by what HTML says about them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head nav header footer aside form script style noscript template textarea select button iframe dialog "
    "title object svg canvas audio video menu noembed noframes xmp".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul caption option".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption option li dd dt body html".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main body html td th blockquote form nav aside header footer".split())
MAIN = frozenset(("article", "main"))
# Words in class, id or role of elements that are not main text.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner sidebar aside nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer copyright cookie cookies consent notice notices alert popup modal "
    "newsletter subscribe signup login share sharing social comment comments disqus respond reply replies related "
    "recommended widget toolbar pagination pager search complementary contentinfo".split()
)
# Words that may go with them in one class or id and say no more than where or what shape it is.
SHAPES = frozenset(
    "box block wrapper wrap container inner outer bar area section list links link top bottom left right main site page "
    "global primary secondary content text item items group row col panel small large fixed sticky desktop mobile".split()
)
# Words that tell furniture whatever they go with, as in post-comments or related-posts, and words that deny it.
READERS = frozenset("comment comments disqus respond reply replies related recommended".split())
DENIED = frozenset("no not has have with without hide hidden enable enabled disable disabled".split())
# How far a text is from main text: it is not, an article around it is in furniture by class, it is itself, it is by element.
CLEAR, RESCUED, NAMED, HARD = range(4)


def tokens(html):
    """(kind, name, value) of tags and text nodes in order; kinds are open, close and text.

    Reads forward only. The first tag that its quotes keep open to the end of the page shows that quotes
    cannot be trusted there; from then on a tag ends at the first sign that can end it.
    """
    at, end, text_from, tag = 0, len(html), 0, _TAG
    last = html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        aside = _ASIDE.match(html, at) if html[at + 1 : at + 2] in ("!", "?") else None
        match = None
        if aside is None:
            if at < last and (html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] == "/"):
                match = tag.match(html, at)
                if match is None and tag is _TAG and _PLAIN_TAG.match(html, at):
                    tag = _PLAIN_TAG
                    match = tag.match(html, at)
            if match is None:
                at += 1
                continue
        if at > text_from:
            yield "text", "", html[text_from:at]
        at = text_from = (aside or match).end()
        if aside:
            continue
        name = match.group(2).lower()
        if match.group(1):
            yield "close", name, ""
            continue
        yield "open", name, match.group(3)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            at = text_from = stop.end() if stop else end
            yield "close", name, ""
    if text_from < end:
        yield "text", "", html[text_from:]


@lru_cache(1 << 13)
def attributes_of(attributes):
    """Name and value of each attribute; the first of a name counts."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes or ""):
        found.setdefault(name.lower(), "".join(values))
    return found


def names_furniture(token):
    """A whole class or id of furniture words, with words of shape at most: ad-box, but not no-sidebar or social-policy."""
    parts = [part.lower().rstrip("0123456789") for part in _PARTS.split(token)]
    parts = {part for part in parts if part}
    return bool(parts & FURNITURE) and parts <= FURNITURE | SHAPES


def names_readers(token):
    """A class or id of reader comments or of other pages: comments, post-comments, related-posts, but not no-comments."""
    parts = {part.lower().rstrip("0123456789") for part in _PARTS.split(token)}
    return bool(parts & READERS) and not parts & DENIED


@lru_cache(1 << 13)
def furniture_level(name, attributes):
    if name in SKIPPED:
        return HARD
    if not attributes or name in ("html", "body"):
        return CLEAR
    found = attributes_of(attributes)
    words = [word for key in ("class", "id", "role") for word in found.get(key, "").split()]
    if any(map(names_readers, words)):
        return HARD
    if name in MAIN:
        return CLEAR
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return HARD
    if "display:none" in found.get("style", "").lower().replace(" ", ""):
        return HARD
    return NAMED if any(map(names_furniture, words)) else CLEAR


def nodes(html):
    """(kind, place, block, furniture, main, text) of every tag and text node of a page; a tag's text is its attributes.

    `furniture` is a level; an article or main element in furniture by class alone is RESCUED from it. `place` is a
    number for the path of open elements; `block` numbers the block a text belongs to. Elements HTML
    closes by itself are closed; end tags without a start are ignored.
    """
    stack = []  # (name, place, furniture, main)
    opened = Counter()
    block = 0
    for kind, name, value in tokens(html):
        top = stack[-1] if stack else ROOT
        if kind == "text":
            yield "text", top[1], block, top[2], top[3], value
            continue
        if name in BLOCKS:
            block += 1
        if kind == "close":
            _close(stack, opened, {name}, SCOPES if name == "p" else ())
            continue
        if name in CLOSES_P:
            _close(stack, opened, {"p"}, SCOPES)
        if name in SAME_CLOSES:
            _close(stack, opened, SAME_CLOSES[name], SCOPES)
        top = stack[-1] if stack else ROOT
        above = RESCUED if top[2] == NAMED and name in MAIN and not top[3] else top[2]
        here = (name, _below(top[1], name), max(above, furniture_level(name, value)), top[3] or name in MAIN)
        yield "tag", here[1], block, here[2], here[3], value
        if name in VOID:
            if name == "br" or name == "hr":
                yield "text", top[1], block, top[2], top[3], " "
        elif not value.endswith("/") or name not in ("svg", "path"):
            stack.append(here)
            opened[name] += 1


ROOT = ("", 0, CLEAR, False)


def _below(place, name):
    """Number of the path one element further; the same on every machine."""
    return (place * 0x9E3779B97F4A7C15 + zlib.crc32(name.encode("utf-8", "surrogatepass")) + 1) & 0xFFFFFFFFFFFFFFFF


def _close(stack, opened, names, scopes):
    """Close the innermost open element of these names, unless one of `scopes` lies further in."""
    if not any(opened[name] for name in names):
        return
    for depth in range(len(stack) - 1, -1, -1):
        if stack[depth][0] in names:
            for name, *_ in stack[depth:]:
                opened[name] -= 1
            del stack[depth:]
            return
        if stack[depth][0] in scopes:
            return


def _class_of(attributes):
    return [value for key, value in attributes_of(attributes).items() if key in ("class", "id")]


def token_hash(place, text="", is_tag=False):
    """Number of a token; those of tags are odd."""
    digest = hashlib.blake2b(f"{place}\x00{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) & -2 | is_tag


@lru_cache(1 << 13)
def tag_hash(place, attributes):
    return token_hash(f"{place} {' '.join(_class_of(attributes))}", is_tag=True)


def squeeze(text):
    """Text of one node with references decoded and white space as one blank."""
    return _SPACE.sub(" ", html_entities.unescape(text)).strip()


# The first token of every page, which stands for the page itself.
PAGE = 1


def page_tokens(html):
    """Tokens of a page in order."""
    found = [PAGE]
    for kind, place, _, _, _, text in nodes(html):
        if kind == "tag":
            found.append(tag_hash(place, text))
        elif text := squeeze(text):
            found.append(token_hash(place, text))
    return found


def _sequences(batches):
    for batch in batches:
        found = pa.array([page_tokens(html or "") for html in batch.column("html").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("host"), found], ["host", "tokens"])


VECTORS = "host string, token bigint, pages bigint, occurrences bigint, vector bigint"


def _signed_mix(page, count):
    digest = hashlib.blake2b(b"%d %d" % (page, count), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _vectors(batches):
    task = TaskContext.get().partitionId()
    page, seen = 0, {}
    for batch in batches:
        for host, tokens in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist()):
            page += 1
            counts = Counter(tokens)
            mixed = {n: _signed_mix((task << 40) + page, n) for n in set(counts.values())}
            for token, n in counts.items():
                old = seen.get((host, token), (0, 0, 0))
                seen[(host, token)] = (old[0] + 1, old[1] + n, old[2] ^ mixed[n])
            if len(seen) >= FLUSH:
                yield _flushed(seen, ("host", "token", "pages", "occurrences", "vector"))
                seen = {}
    yield _flushed(seen, ("host", "token", "pages", "occurrences", "vector"))


def _flushed(seen, names):
    """The sums of a task as one batch; all columns but the host are numbers."""
    columns = list(zip(*((*key, *value) for key, value in seen.items()))) or [()] * len(names)
    types = [pa.string()] + [pa.int64()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, types)], list(names))


def _pages_and_classes(batches):
    """(host, tokens, class by token, size by class) of pages; the classes of a host are unpacked as long as it lasts."""
    of = {}
    for batch in batches:
        columns = [batch.column(name) for name in ("host", "tokens", "members", "ranks")]
        for at, (host, tokens) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist())):
            if host not in of:
                if len(of) >= KNOWN:
                    of.clear()
                numbers = columns[3][at].as_py()
                of[host] = dict(zip(columns[2][at].as_py(), numbers)), Counter(numbers)
            yield host, tokens, *of[host]


# So many hosts have their classes unpacked at once in a task.
KNOWN = 256
ORDERS = "host string, rank bigint, tokens array<bigint>, times bigint"
MOVERS = "host string, rank bigint, token bigint"


def page_classes(tokens, class_of):
    """The tokens of each class on a page, in order."""
    found = {}
    for token in tokens:
        rank = class_of.get(token)
        if rank is not None:
            found.setdefault(rank, []).append(token)
    return found


def _orders(batches):
    """Orders in which the tokens of classes occur, with the number of times."""
    seen, size = Counter(), 0
    for host, tokens, class_of, sizes in _pages_and_classes(batches):
        for rank, found in page_classes(tokens, class_of).items():
            n = sizes[rank]
            for at in range(0, len(found), n):
                order = tuple(found[at : at + n])
                if len(set(order)) == n:
                    seen[(host, rank, order)] += 1
                    size += n if seen[(host, rank, order)] == 1 else 0
        if size >= FLUSH:
            yield _orders_flushed(seen)
            seen, size = Counter(), 0
    yield _orders_flushed(seen)


def _orders_flushed(seen):
    hosts, ranks, orders = zip(*seen) if seen else ((), (), ())
    columns = [pa.array(hosts, pa.string()), pa.array(ranks, pa.int64()), pa.array(map(list, orders), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], ["host", "rank", "tokens", "times"])


def out_of_order(found, place):
    """Tokens of a class on one page that are not where `place` has them: each in the n-th occurrence of the class
    the n-th time it is read, and in an occurrence in rising order with all that are in order there.

    Of two that change places, neither is in order.
    """
    n, turns, moved = len(place), Counter(), set()
    if all(place[token] == at % n for at, token in enumerate(found)):
        return moved
    for at, token in enumerate(found):
        if turns[token] != at // n:
            moved.add(token)
        turns[token] += 1
    for at in range(0, len(found), n):
        here = [place[token] for token in found[at : at + n] if token not in moved]
        upto = _rising(here)
        after = _rising([-one for one in reversed(here)])[::-1]
        longest = max(upto, default=0)
        fitting = [i + j - 1 == longest for i, j in zip(upto, after)]
        alone = Counter(i for i, fits in zip(upto, fitting) if fits)
        kept = {one for one, i, fits in zip(here, upto, fitting) if fits and alone[i] == 1}
        moved.update(token for token in found[at : at + n] if place[token] not in kept)
    return moved


def _rising(numbers):
    """Length of the longest rising sequence that ends at each of the numbers."""
    ends, lengths = [], []
    for number in numbers:
        at = bisect_left(ends, number)
        ends[at : at + 1] = [number]
        lengths.append(at + 1)
    return lengths


def _movers(batches):
    """Tokens that are not in the commonest order of their class on some page."""
    seen, places, last = {}, {}, None
    for host, tokens, class_of, sizes in _pages_and_classes(batches):
        if class_of is not last:
            last, places = class_of, {}
            for token, rank in class_of.items():
                place = places.setdefault(rank, {})
                place[token] = len(place)
        for rank, found in page_classes(tokens, class_of).items():
            for token in out_of_order(found, places[rank]):
                seen[(host, rank, token)] = ()
        if len(seen) >= FLUSH:
            yield _flushed(seen, ("host", "rank", "token"))
            seen = {}
    yield _flushed(seen, ("host", "rank", "token"))


def _without(members, ranks, moved):
    """Members and ranks without those that move; classes left without tags go."""
    moved = set(moved or ())
    tagged = {rank for token, rank in zip(members, ranks) if token & 1 and token not in moved}
    kept = [(token, rank) for token, rank in zip(members, ranks) if rank in tagged and token not in moved]
    return [token for token, _ in kept], [rank for _, rank in kept]


PLACES = "host string, rank bigint, parent bigint, gap bigint, crossing bigint"


def page_places(tokens, class_of, sizes):
    """Where ordered classes lie on a page, as a set of (rank, parent, gap), and the ranks of those that cross a better one.

    A gap is the number of the parent's tokens in front of it. What lies in no class has the parent -1.
    """
    places, crossing, read, stack = set(), set(), {}, []
    for token in tokens:
        rank = class_of.get(token)
        if rank is None or rank in crossing:
            continue
        if rank not in read:
            places.add((rank, stack[-1], read[stack[-1]]) if stack else (rank, -1, 0))
            if sizes[rank] > 1:
                read[rank] = 1
                stack.append(rank)
            continue
        # Classes begun after this one and not at their end cross it.
        while stack[-1] > rank:
            crossing.add(stack[-1])
            del read[stack.pop()]
        if stack[-1] != rank:
            crossing.add(rank)
            stack.remove(rank)
            del read[rank]
            continue
        read[rank] += 1
        if read[rank] == sizes[rank]:
            del read[stack.pop()]
    return places, crossing


def _places(batches):
    seen = {}
    for host, tokens, class_of, sizes in _pages_and_classes(batches):
        places, crossing = page_places(tokens, class_of, sizes)
        for place in places:
            crosses = place[0] in crossing
            if crosses or (host, *place) not in seen:
                seen[(host, *place)] = (int(crosses),)
        if len(seen) >= FLUSH:
            yield _flushed(seen, ("host", "rank", "parent", "gap", "crossing"))
            seen = {}
    yield _flushed(seen, ("host", "rank", "parent", "gap", "crossing"))


def nested_classes(places):
    """Ranks of the classes that are nested, from (rank, parent, gap, crossing); better ones are taken first.

    A class is taken if it has one place among those taken, and they still have one each. What lies in a class
    that is not taken lies where that one does.
    """
    above, inside, crossing = {}, {}, set()
    for rank, parent, gap, crosses in places:
        above.setdefault(rank, set()).add((parent, gap))
        inside.setdefault(parent, set()).add(rank)
        if crosses:
            crossing.add(rank)
    taken = set()

    def has_one_place(rank, among):
        found, seen, todo = set(), set(), [rank]
        while todo:
            for place in above[todo.pop()] - seen:
                seen.add(place)
                if place[0] in among or place[0] < 0:
                    found.add(place)
                else:
                    todo.append(place[0])
        return len(found) == 1

    def next_inside(rank):
        found, seen, todo = set(), {rank}, [rank]
        while todo:
            for child in inside.get(todo.pop(), set()) - seen:
                seen.add(child)
                if child in taken:
                    found.add(child)
                else:
                    todo.append(child)
        return found

    for rank in sorted(above):
        if rank not in crossing and all(has_one_place(one, taken | {rank}) for one in {rank} | next_inside(rank)):
            taken.add(rank)
    return taken


def _furniture(places, members, ranks):
    taken = nested_classes(places)
    return [token for token, rank in zip(members, ranks) if rank in taken and not token & 1]


def equivalence_classes(counted, min_pages):
    """(host, members, ranks): tokens of the frequent classes with tags, those on most pages and with most tokens first.

    The list is no longer than what two pages have, since each of its tokens is on half of them.
    """
    is_tag = F.col("token").bitwiseAND(1) == 1
    hosts = counted.groupBy("host").agg(
        F.max(F.when(F.col("token") == PAGE, F.col("pages"))).alias("host_pages"),
        F.count_if(~is_tag & (F.col("pages") == 1)).alias("own_texts"),
    ).filter((F.col("host_pages") >= min_pages) & (F.col("own_texts") * 2 >= F.col("host_pages")))
    # A third of all pages may be of one host, but its frequent tokens are as few as any host's; what is
    # too rare for any host stays where it is.
    candidates = counted.filter(F.col("pages") * 2 >= min_pages)
    frequent = candidates.join(hosts, "host").filter(F.col("pages") * 2 >= F.col("host_pages"))
    classes = frequent.groupBy("host", "vector", "pages", "occurrences").agg(
        F.max(is_tag).alias("tagged"), F.array_sort(F.collect_set("token")).alias("tokens")
    ).filter("tagged")
    ranked = F.struct(-F.col("pages"), -F.size("tokens"), F.col("occurrences"), F.col("tokens").alias("tokens"))
    listed = classes.groupBy("host").agg(F.array_sort(F.collect_list(ranked)).alias("classes"))
    return _by_host(listed.select("host", F.posexplode("classes").alias("rank", "class")).select("host", "rank", "class.tokens"))


def _by_host(classes):
    """(host, members, ranks) of (host, rank, tokens): all tokens of a host's classes, those of the best one first."""
    listed = classes.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), "tokens"))).alias("classes")
    )
    return listed.select(
        "host",
        F.flatten(F.transform("classes", lambda one: one["tokens"])).alias("members"),
        F.flatten(F.transform("classes", lambda one: F.transform(one["tokens"], lambda _: one["rank"]))).alias("ranks"),
    )


def deduce_templates(pages, min_pages=MIN_PAGES):
    """(host, furniture): hashes of the text nodes in each host's template.

    Text that is on every page in the same way as the page's own structure is in the same class as that
    structure, if it is also in a fixed place of it.
    """
    tables = run_tables(pages, "templates")
    sequences = tables.write(pages.mapInArrow(_sequences, "host string, tokens array<bigint>"), "tokens")
    counted = sequences.mapInArrow(_vectors, VECTORS).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"), F.bit_xor("vector").alias("vector")
    )
    classes = tables.write(equivalence_classes(tables.write(counted, "vectors"), min_pages), "classes")
    orders = sequences.join(classes, "host").mapInArrow(_orders, ORDERS).groupBy("host", "rank", "tokens").agg(F.sum("times").alias("times"))
    orders = orders.groupBy("host", "rank").agg(F.max(F.struct("times", "tokens"))["tokens"].alias("tokens"))
    common = tables.write(_by_host(orders), "orders")
    movers = sequences.join(common, "host").mapInArrow(_movers, MOVERS).groupBy("host").agg(F.collect_set("token").alias("moved"))
    without = F.udf(_without, "members array<bigint>, ranks array<bigint>").asNondeterministic()
    ordered = common.join(movers, "host", "left").withColumn("_c", without("members", "ranks", "moved"))
    ordered = tables.write(ordered.select("host", "_c.members", "_c.ranks"), "ordered")
    places = sequences.join(ordered, "host").mapInArrow(_places, PLACES).groupBy("host", "rank", "parent", "gap").agg(
        F.max("crossing").alias("crossing")
    )
    places = places.groupBy("host").agg(F.collect_list(F.struct("rank", "parent", "gap", "crossing")).alias("places"))
    furniture = F.udf(_furniture, "array<bigint>").asNondeterministic()
    return places.join(ordered, "host").select("host", furniture("places", "members", "ranks").alias("furniture"))


def main_text(html, furniture=frozenset()):
    """Main text of one page: its article, or the slots of its body, a line for each block.

    Articles in furniture by class are taken if there is no other. A page of nothing but furniture has no main text.
    """
    seen = [
        (block, main, place, text, level)
        for kind, place, block, level, main, text in nodes(html)
        if kind == "text" and level < HARD
    ]
    for least, most, of_main in ((CLEAR, CLEAR, True), (RESCUED, RESCUED, True), (CLEAR, CLEAR, False)):
        found = [row for row in seen if least <= row[4] <= most and (row[1] or not of_main)]
        if any(row[3].strip() for row in found):
            break
    # That a text is as frequent as some tag does not make it template inside an article.
    slots = [row for row in found if not furniture or row[1] or token_hash(row[2], squeeze(row[3])) not in furniture]
    if not any(row[3].strip() for row in slots):
        slots = found
    lines, last = [], None
    for block, _, _, text, _ in slots:
        # References are decoded node by node: markup between the halves of one keeps it from being one.
        if block == last:
            lines[-1].append(html_entities.unescape(text))
        else:
            lines.append([html_entities.unescape(text)])
            last = block
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in lines)
    return "\n".join(line for line in lines if line)


def _extract_all(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, furniture in rows:
        yield pd.Series(
            [main_text(one or "", frozenset(np.asarray(drop).tolist()) if drop is not None else frozenset()) for one, drop in zip(html, furniture)],
            dtype=object,
        )


def extract_pages(pages, min_pages=MIN_PAGES):
    """page_id, url, text and n_chars of every page.

    A page without html has empty text. Pages without a host are a host of their own. Repeated rows are
    read one by one. Null ids and URLs stay null. Malformed markup is read as far as it goes. Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", url_host_path(F.col("url").cast("string"))[0].alias("host"), F.col("html").cast("string"))
    templates = run_tables(pages, "templates").write(deduce_templates(rows.select("host", "html"), min_pages), "furniture")
    # One row per host with furniture; the pages move only if these are too many to broadcast.
    extracted = F.pandas_udf(_extract_all, "string").asNondeterministic()
    text = extracted("html", "furniture").alias("text")
    return rows.join(templates, "host", "left").select("page_id", "url", text).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
