"""Main text by wrapper inference (operator 4).

Pages of a host are streams of typed text blocks. Union-free regular
expressions over these, the host's wrapper, grow by alignment: equal tokens
match, texts that differ become slots, runs of one token group become repeated
groups, tokens without a partner become optional groups. Each text node keeps
the digests of the texts that all its pages share. Each page is then matched
against its host's wrapper. The element that holds most of the differing text
is the article. A text that all pages share is judged by its place in the
wrapper: between the article's slots (anywhere in it, if it is an ``article``
or ``main`` element) it is content, such as a standing subheading or byline;
before, after and outside of them it is furniture. Lists of tags and names
decide only what this leaves open: hosts of fewer than MIN_PAGES different
pages, hosts whose differing text lies in several elements, and groups in the
article that are named as furniture.

Wrappers are folded within tasks first, then by host and salt, then by host:
what moves is one wrapper a host and task, however many pages it stands for.

Defined cases: null html is the empty page, its text is empty; a null or odd
url has the host ''; repeated rows are separate pages with equal texts; an
empty table gives no rows; html of any length is read whole, with memory
linear in it and, for the alignment, one bit for each pair of its blocks with
the wrapper's up to CELLS (beyond, both are halved first); other columns don't
matter (see common.pick). Broken markup is read as browsers do as far as
paragraphs, unknown closing tags and unclosed elements go.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick, shuffle_partitions, stored, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title|iframe|textarea|select|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
#: Numbers of things (post-17, p1234), not those of names (c1, h2).
_NUMBER = re.compile(r"(?<![a-z\d])\d+|\d{3,}")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line; their borders are no white space.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var".split())
#: Blocks that hold lines; their end tags may be missing.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre summary legend option".split())
FURNITURE = frozenset("nav footer aside form header menu dialog fieldset button".split())
#: Words of class, id and role that name furniture.
NAMES = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice\w*|alert|popup|modal"
    r"|newsletter|subscri\w*|signup|login|search|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|comments?|replies|reply|respond|disqus|discussion|form|widget|toolbar|copyright|hidden|contentinfo|complementary)(?:$|[-_ \d])"
)
CONTENT = re.compile(r"(?:^|[-_ ])(?:article|content|main|post|entry|story|body)(?:$|[-_ ])")
#: Tasks that fold a host's wrappers before the last: that one has at most so many to fold, whatever the host's size.
SALTS = 64
#: Texts that fewer different pages share tell nothing.
MIN_PAGES = 3
MAX_BROADCAST_BYTES = 32_000_000
#: Pairs of blocks whose bits are held at once.
CELLS = 1 << 28


def _label(tag: str, attrs: str) -> str:
    """tag with its class, id and role words, numbers of things made equal."""
    names = []
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                names.append("hidden")
            elif name in ("class", "id", "role"):
                names += value.split()
    return tag + "".join("." + _NUMBER.sub("0", re.sub(r"[/|]", "_", x)) for x in sorted(set(names)))


def blocks_of(page: str | None) -> list[tuple[str, str, str]]:
    """(container path, leaf tag or '', text) of each block with text, in page order."""
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, str]] = []  # (tag, path)
    path, leaf, text, at = "", "", [], 0

    def flush():
        nonlocal text
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                out.append((path, leaf, " ".join(words)))
            text = []

    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and tag != "wbr":
                text.append("\n")
            continue
        flush()
        if m.group(2):
            if tag in LEAF:
                leaf = ""
            elif any(t == tag for t, _ in stack):
                while stack and stack.pop()[0] != tag:
                    pass
                path = stack[-1][1] if stack else ""
                leaf = ""
        elif tag in LEAF:
            named = _label(tag, m.group(4))
            leaf = named
        else:
            leaf = ""
            path = f"{path}/{_label(tag, m.group(4))}"
            stack.append((tag, path))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


# ---- wrappers: lists of nodes [token], ["#", text or None], ["?", nodes], ["+", nodes], and
# ["#path|leaf", {digest: characters} of texts on all pages, digests of up to MIN_PAGES pages, pages, characters] --------


def _sig(node: list) -> str:
    return f"{node[0]}({' '.join(map(_sig, node[1]))})" if node[0] in "?+" and len(node) > 1 else node[0]


def _body(node: list) -> list:
    return node[1] if node[0] in "?+" and len(node) > 1 else [node]


def _same(a: list, b: list, within: bool = False) -> list:
    """One node for two of one signature, of different pages or within one: texts that differ become a slot."""
    if a[0] in "?+" and len(a) > 1:
        return [a[0], [_same(x, y, within) for x, y in zip(a[1], b[1], strict=True)]]
    if a[0][0] != "#":
        return a
    if len(a) == 2:
        return a if a[1] == b[1] else [a[0], None]
    shared = a[1] | b[1] if within else {k: n for k, n in a[1].items() if k in b[1]}
    seen = a[2] if a[2] == b[2] else sorted({*a[2], *b[2]})[:MIN_PAGES]
    return [a[0], shared, seen, max(a[3], b[3]) if within else a[3] + b[3], a[4] + b[4], *([a[5] + b[5]] if len(a) > 5 else [])]


def fold(nodes: list, most: int = 8) -> list:
    """Runs of equal token groups of up to `most` nodes become repeated groups."""
    changed = True
    while changed:
        changed = False
        sigs = [_sig(n) for n in nodes]
        i, out = 0, []
        while i < len(nodes):
            for size in range(1, min(most, (len(nodes) - i) // 2) + 1):
                if sigs[i] != "#" and sigs[i : i + size] == sigs[i + size : i + 2 * size]:
                    body, j = nodes[i : i + size], i + size
                    while sigs[j : j + size] == sigs[i : i + size]:
                        body = [_same(a, b, True) for a, b in zip(body, nodes[j : j + size], strict=True)]
                        j += size
                    out.append(["+", body] if not (size == 1 and body[0][0] == "+") else body[0])
                    i, changed = j, True
                    break
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _fold_known(nodes: list, bodies: list[list]) -> list:
    """Single occurrences of groups that repeat elsewhere become repeated groups too."""
    for body in bodies:
        want = [_sig(n) for n in body]
        i, out = 0, []
        while i < len(nodes):
            if [_sig(n) for n in nodes[i : i + len(want)]] == want:
                out.append(["+", nodes[i : i + len(want)]])
                i += len(want)
            else:
                out.append(nodes[i])
                i += 1
        nodes = fold(out)
    return nodes


def _bare(w: list) -> list[tuple[str, list, bool]]:
    return [(_sig(x), x, n[0] == "?" and len(n) > 1) for n in w for x in (n[1] if n[0] == "?" and len(n) > 1 else [n])]


def _repeated(w: list) -> list[list]:
    return [n[1] for n in w if n[0] == "+" and len(n) > 1]


def _rows(x: list, y: list) -> list[int]:
    """For each i, which suffixes of y have a longer common subsequence with x[i:] than the next shorter one: bit k is 0 where that of k + 1 symbols has."""
    masks: dict = {}
    for k, c in enumerate(reversed(y)):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for c in reversed(x):
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows[::-1]


def _lengths(x: list, y: list) -> list[int]:
    """Length of a longest common subsequence of x and each suffix of y, the longest suffix first."""
    row, out = _last_row(x, y), [0]
    for k in range(len(y)):
        out.append(out[-1] + (~row >> k & 1))
    return out[::-1]


def _last_row(x: list, y: list) -> int:
    masks: dict = {}
    for k, c in enumerate(reversed(y)):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(y)) - 1
    row = full
    for c in reversed(x):
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def _pairs(x: list, y: list, cells: int = CELLS):
    """(i, j) in order over a longest common subsequence of x and y by their first entries; None for a place without a partner."""
    yield from _paired([n[0] for n in x], [n[0] for n in y], 0, 0, cells)


def _paired(x: list, y: list, i0: int, j0: int, cells: int):
    if len(x) * len(y) > cells and len(x) > 1:
        half = len(x) // 2
        after = _lengths(x[half:], y)
        before = _lengths(x[:half][::-1], y[::-1])[::-1]
        cut = max(range(len(y) + 1), key=lambda j: before[j] + after[j])
        yield from _paired(x[:half], y[:cut], i0, j0, cells)
        yield from _paired(x[half:], y[cut:], i0 + half, j0 + cut, cells)
        return
    rows, m = _rows(x, y), len(y)
    best = lambda i, j: m - j - (rows[i] & ((1 << (m - j)) - 1)).bit_count()
    i = j = 0
    while i < len(x) or j < m:
        if i < len(x) and j < m and x[i] == y[j]:
            yield i0 + i, j0 + j
            i, j = i + 1, j + 1
        elif j == m or i < len(x) and best(i + 1, j) >= best(i, j + 1):
            yield i0 + i, None
            i += 1
        else:
            yield None, j0 + j
            j += 1


def align(a: list, b: list) -> list:
    """The least wrapper that covers both: longest common subsequence of nodes, the rest optional."""
    if [_sig(n) for n in a] == [_sig(n) for n in b]:
        return [_same(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _fold_known(a, _repeated(b)), _fold_known(b, _repeated(a))
    x, y = _bare(a), _bare(b)
    out: list = []
    run = None  # the page whose blocks without a partner the last group holds

    def maybe(node, of=None):
        nonlocal run
        if of and of == run:
            out[-1][1].append(node)
        else:
            out.append(["?", [node]])
        run = of

    for i, j in _pairs(x, y):
        if i is not None and j is not None:
            node = _same(x[i][1], y[j][1])
            if x[i][2] or y[j][2]:
                maybe(node)
            else:
                out.append(node)
                run = None
        else:
            # Blocks that stand together on one page are optional together; what was optional before is so by itself.
            node, before = (x[i][1], x[i][2]) if j is None else (y[j][1], y[j][2])
            maybe(node, None if before else "x" if j is None else "y")
    return out


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def stream_of(blocks: list[tuple[str, str, str]], numbered: bool = False) -> list:
    """Text nodes of a page by container and leaf, with digests of the whole texts; numbered: with the blocks' numbers."""
    page = _digest("\n".join(text for _, _, text in blocks))
    return fold([[f"#{path}|{leaf}", {_digest(text): len(text)}, [page], 1, len(text), *([[i]] if numbered else [])] for i, (path, leaf, text) in enumerate(blocks)])


def _texts(nodes: list, repeated: bool = False):
    """(text node, whether it repeats) of a wrapper or page."""
    for n in nodes:
        if n[0] in "?+" and len(n) > 1:
            yield from _texts(n[1], repeated or n[0] == "+")
        else:
            yield n, repeated


class Wrapper:
    """nodes and the number of pages."""

    def __init__(self, nodes: list, pages: int):
        self.nodes, self.pages = nodes, pages

    @classmethod
    def of(cls, blocks):
        return cls(stream_of(blocks), 1)

    def add(self, other: Wrapper) -> None:
        self.nodes = align(self.nodes, other.nodes)
        self.pages += other.pages

    def dump(self) -> str:
        return json.dumps([self.nodes, self.pages])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))


def _inside(path: str, root: str) -> bool:
    return path == root or path.startswith(f"{root}/")


def _smallest(mass: Counter) -> str:
    """Down to the smallest element that holds most of the text."""
    total, root = sum(mass.values()), ""
    while total:
        below = Counter()
        for p in mass:
            if p.startswith(f"{root}/"):
                below[root + "/" + p[len(root) + 1 :].split("/")[0]] += mass[p]
        top = max(below, key=lambda k: (below[k], k), default=None)
        if top is None or below[top] < 0.7 * total:
            break
        root = top
    return root


def _tag(part: str) -> str:
    return part.partition(".")[0]


def _named(part: str) -> bool:
    return bool(NAMES.search(part.partition(".")[2].replace(".", " ")))


def _by_names(mass: Counter) -> set[str]:
    """Container paths of the main text by tags and names, else by mass."""
    open_ = {p for p in mass if not is_furniture(p)}
    for test in (lambda x: _tag(x) == "article", lambda x: _tag(x) == "main", lambda x: bool(CONTENT.search(x.partition(".")[2].replace(".", " ")))):
        if found := {p for p in open_ if any(map(test, p.split("/")))}:
            return found
    root = _smallest(Counter({p: mass[p] for p in open_}))
    return {p for p in open_ if _inside(p, root)}


class Reader:
    """Reads pages of one host by its wrapper."""

    def __init__(self, wrapper: Wrapper | None):
        self.nodes = wrapper.nodes if wrapper else []
        self.matches: dict[str, list] = {}
        self.shared: dict[str, set] = {}
        #: Places of the wrapper whose texts are content even if all pages share them.
        self.content: set[int] = set()
        mass, keys, known, slots = Counter(), {}, False, []
        places = list(_texts(self.nodes))
        self.place = {id(n): k for k, (n, _) in enumerate(places)}
        for k, (n, again) in enumerate(places):
            path = n[0][1:].rpartition("|")[0]
            sure = len(n[2]) >= MIN_PAGES
            known = known or sure
            if sure:
                self.shared.setdefault(n[0], set()).update(n[1])
            left = n[4] - n[3] * sum(n[1].values()) if sure else n[4]
            if left > 0:
                mass[path] += left
                keys[n[0]] = keys.get(n[0], False) or again
                slots.append(k)
        root = _smallest(mass) if known else ""
        if _tag(root.rpartition("/")[2]) in ("", "html", "body"):  # no evidence, or none for one element
            paths = _by_names(mass)
            self.kept = {k for k in keys if k[1:].rpartition("|")[0] in paths and not _named(k.rpartition("|")[2])}
            inside = {p for p in paths if any(_tag(x) in ("article", "main") for x in p.split("/"))}
            self.content = {k for k, (n, _) in enumerate(places) if n[0][1:].rpartition("|")[0] in inside and not _named(n[0].rpartition("|")[2])}
            return
        parts = root.split("/")
        for i, part in enumerate(parts):
            if _tag(part) in ("article", "main"):
                root = "/".join(parts[: i + 1])
                break
        self.kept = {k for k, again in keys.items() if self._main(k, again, root)}
        whole = _tag(root.rpartition("/")[2]) in ("article", "main")
        own = [k for k in slots if places[k][0][0] in self.kept and _inside(places[k][0][0][1:].rpartition("|")[0], root)]
        for k, (n, _) in enumerate(places):
            if (whole or own and own[0] < k < own[-1]) and _inside(n[0][1:].rpartition("|")[0], root) and self._main(n[0], True, root):
                self.content.add(k)

    @staticmethod
    def _main(key: str, again: bool, root: str) -> bool:
        path, _, leaf = key[1:].rpartition("|")
        if _inside(path, root):
            below = path[len(root) :].split("/")[1:]
            return not any(_tag(x) in FURNITURE and _tag(x) != "header" for x in below) and not (again and any(map(_named, [*below, leaf])))
        # Beside it: what stands in the elements around it, and the page's heading.
        if _inside(root, path) and _tag(path.rpartition("/")[2]) not in ("", "html", "body"):
            return not (again and _named(leaf))
        return _tag(leaf) == "h1" and not again

    def _match(self, nodes: list) -> list:
        """The wrapper's text node, or None, of each text node of a page."""
        # One block and a run of such blocks are the same place.
        one = lambda n: _sig(n[1][0]) if n[0] == "+" and len(n) > 1 and len(n[1]) == 1 else _sig(n)
        x, y = ([(one(n), n, maybe) for _, n, maybe in _bare(w)] for w in (nodes, self.nodes))
        out: list = []
        for i, j in _pairs(x, y):
            if i is not None:
                mine = list(_texts([x[i][1]]))
                out += [None] * len(mine) if j is None else [n for n, _ in _texts([y[j][1]])]
        return out

    def text(self, blocks: list[tuple[str, str, str]]) -> str:
        nodes = _fold_known(stream_of(blocks, True), _repeated([n for _, n, _ in _bare(self.nodes)]))
        shape = " ".join(map(_sig, nodes))
        if shape not in self.matches:
            self.matches[shape] = self._match(nodes)
        furniture: set[int] = set()
        content: set[int] = set()
        for (own, _), node in zip(_texts(nodes), self.matches[shape], strict=True):
            if node is not None and self.place[id(node)] in self.content:
                content.update(own[5])
                continue
            shared = self.shared.get(own[0], ()) if node is None else node[1] if len(node[2]) >= MIN_PAGES else ()
            furniture.update(i for i in own[5] if shared and _digest(blocks[i][2]) in shared)
        kept = [text for i, (path, leaf, text) in enumerate(blocks) if i in content or i not in furniture and f"#{path}|{leaf}" in self.kept]
        if not kept:  # this page has nothing in its host's main containers
            kept = [text for i, (path, leaf, text) in enumerate(blocks) if i not in furniture and not is_furniture(path) and not _named(leaf)]
        return "\n\n".join(kept)


def is_furniture(path: str) -> bool:
    inside = False
    for part in path.split("/"):
        tag, _, names = part.partition(".")
        if tag in FURNITURE and not (tag == "header" and inside):
            return True
        if names and tag not in ("html", "body", "article", "main") and NAMES.search(names.replace(".", " ")):
            return True
        if tag == "article" and names and re.search(r"(?:^|[-_. ])comments?(?:$|[-_. ])", names):
            return True
        inside = inside or tag in ("article", "main")
    return False


def host_of():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _fold_rows(keys: int):
    """Folds wrappers by the first `keys` columns of sorted rows (the last column is the wrapper)."""

    def run(batches):
        now, held = None, None
        for b in batches:
            out = []
            for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = Wrapper.load(text)
                if key == now:
                    held.add(w)
                else:
                    if now is not None:
                        out.append((now[0], held.dump()))
                    now, held = key, w
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], names=["host", "wrapper"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([held.dump()])], names=["host", "wrapper"])

    return run


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """pages(url, html) → (host, wrapper): one wrapper a host, over all its pages."""

    def local(batches):
        for b in batches:
            shapes: dict[tuple[str, str], Wrapper] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = Wrapper.of(blocks_of(page))
                key = (host, " ".join(map(_sig, w.nodes)))
                if key in shapes:
                    shapes[key].add(w)
                else:
                    shapes[key] = w
            hosts: dict[str, Wrapper] = {}
            for (host, _), w in shapes.items():
                if host in hosts:
                    hosts[host].add(w)
                else:
                    hosts[host] = w
            yield pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([w.dump() for w in hosts.values()], pa.string())], names=["host", "wrapper"])

    p = pick(pages, "url", "html").select(host_of().alias("host"), "html")
    parts = shuffle_partitions(pages.sparkSession)
    first = p.mapInArrow(local, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    salted = first.select("host", "salt", "wrapper").repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_fold_rows(2), "host string, wrapper string")
    return salted.repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_fold_rows(1), "host string, wrapper string")


def extract(pages: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """pages(page_id, url, html) → page_id, url, text, n_chars."""
    spark = pages.sparkSession
    wrappers = stored(infer_wrappers(pages), "wrappers")
    p = pick(pages, "page_id", "url", "html").withColumn("_host", host_of())
    kind = p.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def read(b, readers):
        texts = [reader.text(blocks_of(page)) for page, reader in zip(b.column(2).to_pylist(), readers, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    if size <= max_broadcast_bytes:
        sent = spark.sparkContext.broadcast({r[0]: r[1] for r in wrappers.collect()})

        def run(batches):
            known: dict[str, Reader] = {}
            for b in batches:
                hosts = b.column(3).to_pylist()
                for h in set(hosts) - known.keys():
                    known[h] = Reader(Wrapper.load(sent.value[h]) if h in sent.value else None)
                yield read(b, [known[h] for h in hosts])

        return p.mapInArrow(run, schema)
    # More hosts than may be broadcast: pages of a host are dealt over salts, its wrapper goes to each.
    salted = p.withColumn("_salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(4 * SALTS)))
    many = wrappers.select(F.col("host").alias("_host"), "wrapper", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4 * SALTS - 1).cast("long"))).alias("_salt"))
    both = salted.join(many.hint("merge"), ["_host", "_salt"], "left").select("page_id", "url", "html", "wrapper")

    def run_joined(batches):
        for b in batches:
            wrappers_ = b.column(3).to_pylist()
            readers = {w: Reader(Wrapper.load(w) if w else None) for w in set(wrappers_)}
            yield read(b, [readers[w] for w in wrappers_])

    return both.mapInArrow(run_joined, schema)


def op4_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
