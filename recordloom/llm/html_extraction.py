"""Main text of web pages: structure marks the candidates, then a suffix array over each host finds what it repeats.

A page is read once into blocks. Elements whose tag, role, class or id marks them as navigation, header, footer,
sidebar, notice, advert, form, comments, script or style are left out (of a header inside the article its headings
stay). If the page has a main container (article, main, or an element named as content), only its blocks are
candidates and they are firm; else all remaining blocks are candidates and are soft.

The candidates of a page are one token stream. The suffixes of all streams of a host, in the order of the hash of
their first RUN tokens, are a suffix array cut at RUN tokens: neighbours with equal keys have a common prefix of RUN
tokens or more, and the number of distinct pages in a group of equal keys is the support of that prefix. A substring
of RUN tokens or more that S pages share is a chain of overlapping prefixes each shared by S pages, so the supports of
the prefixes over a token say whether any such substring covers it, however long.

On a page, a token is boilerplate if a run over it is on PAGES distinct pages or more, and on more than twice as many
as the lower quartile of the page's tokens: where most of a page is itself repeated, as in versions of one article,
only what is far more widely spread is boilerplate. In firm blocks the run must also be on more than half of the
host's distinct pages, so quotations stay. Covered runs are cut out of their blocks, what is unique to the page stays.

Pages that equal each other count once: the first of each content (by grouped aggregation) stands for all, so supports
are sums that combine within a block of pages before anything moves. Pages stay in blocks of some megabytes, in a
written table; the suffix keys are dealt by range, so neither hosts nor runs make a hot task:

1. the least SEED-gram of each RUN-token window is a filter: a window can be shared only if that gram is. A block
   sends the distinct ones (two fifths of the tokens) and hears which occur in other pages too;
2. it sends the keys of the windows that pass, with the number of its pages that hold each, and hears the supports;
3. it cuts its pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.packs import cut_at, grown, opened, packed, sealed, small, unpacked
from recordloom.llm.staging import stage, stage_by
from recordloom.llm.textblocks import GOLD, POLY, U, mix, owners, release, split_words, tidy

RUN, SEED, PAGES = 8, 5, 3
#: Bytes of text in a block of pages, and pages whose keys one range takes.
BLOCK_BYTES, RANGE_PAGES = 4_000_000, 20_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "noembed", "noframes", "xmp")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav header footer aside form script style noscript iframe template button select option textarea label fieldset svg embed audio video head title menu dialog noembed noframes".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = set("br td th img wbr".split()) - {"wbr"}
SCOPES = set("article aside body div footer header main nav section table td th tr ul ol li form blockquote html".split())
#: Parts of a class, id or role that mark an element as not part of the main text.
MARKS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside cookie cookies consent gdpr notice notices notification alert"
    " ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond replies reply newsletter subscribe signup login"
    " popup modal overlay share sharing social related recommended recommendations widget toolbar search pagination pager form complementary contentinfo skip".split()
)
#: Names that begin so say what a page or post has or is about, and mark nothing; marks that count only as a name's first part.
STATES, LEADING = ("has", "no", "with", "without", "is", "category", "tag", "type", "format", "topic"), {"share", "sharing", "search", "skip", "reply"}
#: Marks that an article can have in its own right; other marks don't take away an outermost article, and none a main element.
FOREIGN = set("comment comments disqus respond replies reply ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended newsletter".split())
#: What marks the header of an article, whose headings are part of the text.
HEADINGS, HEADER_MARKS = set("h1 h2 h3 h4 h5 h6".split()), {"header", "masthead"}
#: Names of a main container that is neither article nor main.
MAIN_NAMES = set("content main maincontent article post entry story articlebody postcontent entrycontent postbody bodycontent".split())


@dataclass
class Page:
    blocks: list[str]
    firm: bool


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """(words, whole names) of class, id and role."""
    words, whole = set(), set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop"):
            for one in html.unescape(value.strip("\"'")).split():
                parts = re.split(r"[-_:.]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower())
                whole.add("".join(parts))
                if len(parts) == 1 or parts[0] not in STATES:
                    words.update(parts[:1], (p for p in parts[1:] if p not in LEADING))
        elif name.lower() == "hidden":
            words.add("modal")
    return words, whole


def read_page(source: str) -> Page:
    """The candidate blocks of a page, and whether they come from a main container."""
    stack: list[tuple[str, int, int]] = []  # tag, dropped (1: but for headings), kind of container it lies in
    blocks: list[tuple[int, list[str]]] = [(0, [])]
    dropped, inside, at, n = 0, 0, 0, len(source)

    def text(piece: str) -> None:
        if not dropped and piece:
            if blocks[-1][0] != inside:
                blocks.append((inside, []))
            blocks[-1][1].append(html.unescape(piece) if "&" in piece else piece)

    def breaks() -> None:
        if blocks[-1][1]:
            blocks.append((inside, []))

    while at < n:
        found = TOKEN.search(source, at)
        if found is None:
            text(source[at:])
            break
        text(source[at : found.start()])
        at, (closing, tag, attributes) = found.end(), found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            breaks()
        elif tag in SPACED:
            text(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES and tag not in SCOPES:
                    break
        elif tag in RAW:
            end = RAW[tag].search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
            words, whole = _names(attributes) if attributes.strip() else (set(), set())
            above = stack[-1] if stack else ("", 0, 0)
            if tag in HEADINGS and above[1] == 1:
                drop = 0
            elif tag == "header" and above[2] >= 2:
                drop = max(above[1], 2 if words & MARKS - HEADER_MARKS else 1)
            else:
                marks = set() if tag in ("body", "html", "main") else words & (FOREIGN if tag == "article" and not above[2] else MARKS)
                drop = 2 if tag in DROPPED or marks else above[1]
            kind = 3 if tag == "article" else 2 if tag == "main" or "main" in words and tag != "body" else 1 if whole & MAIN_NAMES and tag not in ("body", "html") else 0
            stack.append((tag, drop, max(above[2], kind)))
        dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
    done = [(kind, " ".join("".join(parts).split())) for kind, parts in blocks]
    done = [x for x in done if x[1]]
    best = max((kind for kind, _ in done), default=0)
    size = lambda kinds: sum(len(t) for kind, t in done if kind in kinds)
    kept = (1, 2, 3) if best > 1 and size(range(1, best)) > size([best]) else (best,)  # articles beside a longer story are part of it
    return Page([t for kind, t in done if kind in kept], best > 0)


def hashed(values: list[str]) -> np.ndarray:
    return hash_array(np.array(values, object), categorize=False) if values else np.zeros(0, np.uint64)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * POLY + right)


def ahead(values: np.ndarray, k: int, fill: int = 0) -> np.ndarray:
    """values[i + k] at place i."""
    return np.concatenate([values[k:], np.full(min(k, len(values)), fill, np.uint64)])


class Streams:
    """The token streams of a batch of pages (host, blocks) and the suffix keys of their tokens.

    ``starts`` bounds each page's tokens, ``whole`` tells whether RUN tokens begin at a place, ``key`` is the hash of
    the host and these tokens, ``gram`` that of the host and the least SEED-gram among them, of which ``bits`` are kept.
    """

    def __init__(self, hosts: list[str], blocks: pa.Array, bits: int = 64):
        words = split_words(pc.binary_join(blocks, " "), lower=False)
        self.starts = words.starts
        site = np.repeat(mix(hashed(hosts) + GOLD), np.diff(self.starts))
        one = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        two = paired(one, ahead(one, 1))
        four = paired(two, ahead(two, 2))
        self.key = paired(paired(four, ahead(four, 4)), site)
        least = paired(four, ahead(one, 4))
        for step in (1, 2):  # least of RUN - SEED + 1 = 4 in a row
            least = np.minimum(least, ahead(least, step, 0xFFFFFFFFFFFFFFFF))
        self.gram = paired(least, site) >> U(64 - bits) << U(64 - bits)
        named = np.repeat([bool(h) for h in hosts], np.diff(self.starts))
        self.whole = (np.arange(len(one)) + RUN <= np.repeat(self.starts[1:], np.diff(self.starts))) & named
        self.page = owners(self.starts)

    def grams(self, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct grams in order, whether several contents hold it). content: a number for each page."""
        new = self.whole.copy()
        new[1:] &= (self.gram[1:] != self.gram[:-1]) | (self.page[1:] != self.page[:-1]) | ~self.whole[:-1]
        gram, of = self.gram[new], content[self.page[new]]
        order = np.lexsort((of, gram))
        gram, of = gram[order], of[order]
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        begins = np.flatnonzero(first)
        several = of[begins] != of[np.append(begins[1:], len(of)) - 1] if len(begins) else np.zeros(0, bool)
        return gram[begins], several

    def held(self, open_grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys whose gram is open, number of counting pages that hold each). counts: whether a page counts."""
        use = np.flatnonzero(self.whole & found_in(self.gram, open_grams))
        key, page = self.key[use], self.page[use]
        order = np.lexsort((page, key))
        key, page = key[order], page[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (page[1:] != page[:-1])
        keys, place = np.unique(key[new], return_inverse=True)
        return keys, np.bincount(place, weights=counts[page[new]], minlength=len(keys)).astype(np.int64)

    def support(self, table: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        """For each page and token the most pages that hold a run over it; 1 for runs that aren't in the sorted table."""
        over = np.ones(len(self.key), np.int64)
        if len(table):
            at = np.searchsorted(table, self.key)
            at[at == len(table)] = 0
            own = np.where(self.whole & (table[at] == self.key), numbers[at], 1)
            over = own.copy()
            for k in range(1, RUN):
                np.maximum(over[k:], own[:-k], out=over[k:])
        return [over[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]


def found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def summed(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of the numbers given for each)."""
    keys_, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return keys_, np.bincount(place, weights=np.concatenate([np.zeros(0), *numbers]), minlength=len(keys_)).astype(np.int64)


def without(blocks: list[str], firm: bool, support: np.ndarray, distinct: int) -> str:
    """A page's text without what its host repeats. distinct: the number of the host's distinct pages."""
    if not len(support):
        return ""
    usual = int(np.partition(support, len(support) // 4)[len(support) // 4])
    least = max(PAGES, 2 * usual + 1, distinct // 2 + 1 if firm else 0)
    gone = support >= least
    if not gone.any():
        return "\n\n".join(blocks)
    kept, at = [], 0
    for block in blocks:
        n = block.count(" ") + 1
        own, at = gone[at : at + n], at + n
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        cuts = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= min(RUN, n)]  # not what a run of the block beside it happens to reach
        if cuts:
            stays = np.ones(n, bool)
            for a, b in cuts:
                stays[a:b] = False
            block = " ".join(w for w, s in zip(block.split(" "), stays.tolist(), strict=True) if s)
        if block:
            kept.append(block)
    return "\n\n".join(kept)


def contents(blocks: pa.Array) -> np.ndarray:
    """A number of each page's content."""
    return hashed(pc.binary_join(blocks, "\n").to_pylist())


def clean(pages: list[Page]) -> list[str]:
    """The main text of each page of one host, in one go."""
    blocks = pa.array([p.blocks for p in pages], pa.list_(pa.string()))
    streams, content = Streams(["host"] * len(pages), blocks), contents(blocks)
    counts = np.zeros(len(pages), bool)
    counts[np.unique(content, return_index=True)[1]] = True
    gram, several = streams.grams(content)
    table, numbers = streams.held(gram[several], counts)
    return [without(p.blocks, p.firm, s, int(counts.sum())) for p, s in zip(pages, streams.support(table, numbers), strict=True)]


PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("blocks", pa.list_(pa.string())), ("firm", pa.bool_())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, pages): the pages of a task in runs of about BLOCK_BYTES of text."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        pages = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), PAGE, strict=True)], schema=PAGE)
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([sealed(pages)])], ["block", "pages"])

    for batch in batches:
        for page_id, url, host, source in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
            page = read_page(source or "")
            held.append((page_id, url, host, page.blocks, page.firm))
            size += sum(map(len, page.blocks)) + 200
            if size >= BLOCK_BYTES:
                yield row()
                seq, held, size = seq + 1, [], 0
    if held:
        yield row()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])
HEARD = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])
SENT_SQL, HEARD_SQL = "part int, block long, keys binary, numbers binary", "block long, keys binary, numbers binary"


def _sent(block: int, keys: np.ndarray, numbers: np.ndarray, parts: int) -> pa.RecordBatch:
    cuts = cut_at(keys, parts)
    return _batch([(k, block, packed(keys[a:b]), small(numbers[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a], SENT)


def gram_bits(blocks: int) -> int:
    """Bits of a gram that are kept, as they only filter: 9 more than the input's bytes have, so that few grams that no
    other page holds pass with another's number. Supports are counted on whole keys."""
    return min(64, 9 + (max(blocks, 1) * BLOCK_BYTES).bit_length())


def _grams(parts: int, bits: int):
    """The filter grams of each block, by range; number 2 if several of its pages' contents hold one, else 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["pages"], strict=True):
                pages = opened(data.as_buffer())
                gram, several = Streams(pages["host"].to_pylist(), pages["blocks"], bits).grams(contents(pages["blocks"]))
                yield _sent(block, gram, 1 + several, parts)

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, nth, site, c1, c2): each page of a block with a number of its host and two of its content."""
    for batch in batches:
        for block, data in zip(batch["block"].to_pylist(), batch["pages"], strict=True):
            pages = opened(data.as_buffer())
            texts = pc.binary_join(pages["blocks"], "\n").to_pylist()
            twice = [hashed(texts), hash_array(np.array(texts, object), hash_key="fedcba9876543210", categorize=False)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(texts), pa.int64()), pa.array(np.arange(len(texts), dtype=np.int32)), *(pa.array(x.view(np.int64)) for x in (hashed(pages["host"].to_pylist()), *twice))], ["block", "nth", "site", "c1", "c2"])


def _counted(least: int):
    """For each row of a range its keys whose numbers, summed over all blocks, reach ``least``, with the sums."""

    def answers(rows: list[tuple]) -> pa.RecordBatch:
        keys = [unpacked(k) for _, _, k, _ in rows]
        table, total = summed(keys, [grown(n) for *_, n in rows])
        often = total >= least
        table, total = table[often], total[often]
        out = []
        for (_, block, _, _), k in zip(rows, keys, strict=True):
            k = k[found_in(k, table)]
            if len(k):
                out.append((block, packed(k), small(total[np.searchsorted(table, k)])))
        return _batch(out, HEARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in SENT.names), strict=True):
                if held and held[0][0] != row[0]:
                    yield answers(held)
                    held = []
                held.append(row)
        if held:
            yield answers(held)

    return run


def _heard(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    own = answers.filter(pc.is_valid(answers["keys"]))
    return summed([unpacked(k) for k in own["keys"].to_pylist()], [grown(n) for n in own["numbers"].to_pylist()])


def _held(parts: int, bits: int):
    """The keys of a block's windows that pass the filter, by range."""

    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for data in block["pages"]:
            pages = opened(data.as_buffer())
            counts = np.zeros(pages.num_rows, bool)
            for nth in answers["first"].to_pylist():
                counts[nth or []] = True
            keys, numbers = Streams(pages["host"].to_pylist(), pages["blocks"], bits).held(_heard(answers)[0], counts)
            out.append(_sent(key[0].as_py(), keys, numbers, parts))
        return pa.Table.from_batches(out, SENT)

    return run


def _extracted(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
    table, numbers = _heard(answers)
    distinct = {s: m for sites, ms in zip(answers["sites"].to_pylist(), answers["distinct"].to_pylist(), strict=True) for s, m in zip(sites or [], ms or [], strict=True)}
    out = []
    for data in block["pages"]:
        pages = opened(data.as_buffer())
        hosts = pages["host"].to_pylist()
        support = Streams(hosts, pages["blocks"]).support(table, numbers)
        sites = hashed(hosts).view(np.int64).tolist()
        texts = [without(b, f, own, distinct[s]) for b, f, own, s in zip(pages["blocks"].to_pylist(), pages["firm"].to_pylist(), support, sites, strict=True)]
        out.append(pa.table({"page_id": pages["page_id"], "url": pages["url"], "text": pa.array(texts, pa.string())}))
    release()
    return pa.concat_tables(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a null or odd url has no host, and its pages are not compared; repeated
    rows give a row each (equal pages count once as support); an empty table gives no rows; a very long page is a
    block of its own. Ties: the first of equal pages that counts is any of them, with the same result. Results don't
    depend on the order or the partitions of the rows. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    blocks = stage_by(rows.mapInArrow(tidy(_read), "block long, pages binary"), "pages", "block")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, bits = max(n, pages.count() // RANGE_PAGES), gram_bits(blocks.count())
    dealt = lambda sent, least: sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(_counted(least)), HEARD_SQL)
    own = stage(blocks.mapInArrow(tidy(_contents), "block long, nth int, site long, c1 long, c2 long"), "contents")
    first = own.groupBy("site", "c1", "c2").agg(F.min(F.struct("block", "nth")).alias("f")).select("site", "f.*")
    distinct = first.groupBy("site").agg(F.count(F.lit(1)).alias("m"))
    firsts = first.groupBy("block").agg(F.collect_list("nth").alias("first"))
    sizes = own.select("block", "site").distinct().join(distinct, "site").groupBy("block").agg(F.collect_list("site").alias("sites"), F.collect_list("m").alias("distinct"))
    grouped, schema = blocks.groupBy("block"), "page_id long, url string, text string"
    grams = dealt(blocks.mapInArrow(tidy(_grams(parts, bits)), SENT_SQL), 2).unionByName(firsts, allowMissingColumns=True)
    supports = dealt(grouped.cogroup(grams.groupBy("block")).applyInArrow(_held(parts, bits), SENT_SQL), PAGES).unionByName(sizes, allowMissingColumns=True)
    texts = grouped.cogroup(supports.groupBy("block")).applyInArrow(_extracted, schema)
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
