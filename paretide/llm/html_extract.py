"""Operator 2, HTML main text by a recurrent block labeller.

A page is cut into leaf blocks at block-level tags. Each block becomes a vector: its whole tag path (tags, classes, ids
and roles of all ancestors, hashed), its words (hashed) and a few measures of its text. A bidirectional LSTM in NumPy reads the sequence
of a page's blocks, so each label depends on the whole page, and the blocks labelled main text are joined in order.
The network is trained here, in a few seconds, on pages that ``training_pages`` generates from a seed: layouts with
semantic tags, with named containers and with bare tags, whose words are made of random syllables.

Defined results: null and empty html, and pages without main text, give an empty text; malformed markup is read
leniently (an end tag closes the nearest open tag of its name, stray ones are ignored, text of an unclosed comment,
script or style is dropped, a head ends at the first tag or text that cannot stand in it, other dropped elements
without end tag end where a block begins); equal pages give equal texts; an empty table gives an empty table; extra columns play
no part.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import word_hashes
from .shared import frugal

PATH, WORD, MEASURES, HIDDEN = 512, 16, 8, 16
#: Share of the path slots that training hides of a page, so that no single name decides.
DROPOUT = 0.05
SIZE = PATH + WORD + MEASURES
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+", re.I)
# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("script style noscript template svg math head title iframe object select textarea button option canvas audio video".split())
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template head".split())
_BLOCKS = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_NESTED = frozenset("svg math object template".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _ended(page: str, tag: str) -> frozenset[int]:
    """The places behind the names of those start tags ``tag`` that have an end tag of their own."""
    open_at: list[int] = []
    out = set()
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.I):
        if not m[1]:
            if tag not in _NESTED:
                open_at.clear()
            open_at.append(m.end())
        elif open_at:
            out.add(open_at.pop())
    return frozenset(out)


#: Slots of the names on a block's tag path (bits), and the innermost tag; (0, None) outside of all tags.
Path = tuple[int, str | None]


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH


def blocks(page: str) -> list[tuple[str, Path, int]]:
    """(text, tag path, characters inside links) of each leaf block of a page, in linear time.

    Every name on the path counts, however deep; a tag costs no more than what it closes.
    """
    out: list[tuple[str, Path, int]] = []
    stack: list[tuple[str, Path]] = []
    held: list[str] = []
    linked = links = skip = 0
    solid: list[int] = []  # places in the stack of tags that aren't inline
    dropped: list[int] = []  # of dropped elements
    loose: set[int] = set()  # of those without end tag
    opened: Counter[str] = Counter()
    ended: dict[str, frozenset[int]] = {}
    last = page.rfind(">") + 1  # behind it nothing is markup, but for what is left open

    def flush() -> None:
        nonlocal linked
        if held and (text := " ".join(entities.unescape("".join(held)).split())):
            out.append((text, stack[-1][1] if stack else (0, None), linked))
        held.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal links, skip
        for tag, _ in stack[i:]:
            opened[tag] -= 1
            links -= tag == "a"
            skip -= tag in _DROPPED
        del stack[i:]
        for places in (solid, dropped):
            while places and places[-1] >= i:
                loose.discard(places.pop())

    at = 0
    while True:
        m = _MARKUP.search(page, at, last) if at < last else None
        end = len(page)
        if not m:
            end = min((x for x in (page.find("<!--", at), page.find("<![CDATA[", at)) if x >= 0), default=end)
        piece = page[at : m.start() if m else end]
        if piece and stack and stack[-1][0] == "head" and not piece.isspace():
            close(len(stack) - 1)
        if piece and not skip:
            held.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
                at = len(page)  # left open: the rest goes
            continue
        if tag not in _INLINE:
            flush()
        if m[1] or m[4]:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            continue
        attributes = m[3] if m[2] else m[6]
        if loose and tag in _BLOCKS:  # outermost of those that no closed dropped element stands in
            cut = len(stack)
            for i in reversed(dropped):
                if i not in loose:
                    break
                cut = i
            close(cut)
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        if tag in ("script", "style"):
            found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
            at = found.end() if found else len(page)
            continue
        if tag == "br":
            held.append(" ")
        if tag in _VOID or attributes.endswith("/") and tag in _DROPPED:
            continue
        if tag in _CLOSES:
            for i in reversed(solid):
                if stack[i][0] in _CLOSES[tag]:
                    close(i)
                    break
                if stack[i][0] != "p":
                    break
        elif tag not in _INLINE and solid and stack[solid[-1]][0] == "p":  # an open paragraph ends where a block begins
            close(solid[-1])
        path = stack[-1][1] if stack else (0, None)
        if tag not in _INLINE:
            bits = path[0] | 1 << _slot(tag)
            if attributes:
                for v in _NAMES.findall(attributes):
                    for x in _PARTS.findall("".join(v)):
                        bits |= 1 << _slot("." + x.lower())
            path = (bits, tag)
            solid.append(len(stack))
        stack.append((tag, path))
        opened[tag] += 1
        links += tag == "a"
        skip += tag in _DROPPED
        if tag in _DROPPED:
            dropped.append(len(stack) - 1)
            if tag != "head":
                if tag not in ended:
                    ended[tag] = _ended(page, tag)
                if m.start() + 1 + len(tag) not in ended[tag]:
                    loose.add(len(stack) - 1)
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path(path: Path) -> np.ndarray:
    bits, leaf = path
    v = np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), dtype=np.uint8), bitorder="little").astype(np.float32)
    if leaf:
        v[_slot(f"leaf {leaf}")] = 1
    return v


def vectors(page_blocks: list[list[tuple[str, Path, int]]]) -> np.ndarray:
    """The vectors of all blocks of some pages, one after another."""
    flat = [b for page in page_blocks for b in page]
    out = np.zeros((len(flat), SIZE), dtype=np.float32)
    if not flat:
        return out
    texts = [b[0].encode() for b in flat]
    n = np.zeros(len(flat))
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    words = np.zeros((len(flat), WORD), dtype=np.float32)
    for i, j, h, rows in word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, lower=True):
        row = np.repeat(np.arange(j - i), np.diff(rows))
        words[i:j] = np.bincount(row * WORD + (h % np.uint64(WORD)).astype(np.int64), minlength=(j - i) * WORD).reshape(-1, WORD)
        n[i:j] = np.diff(rows)
    out[:, :PATH] = [_path(b[1]) for b in flat]
    out[:, PATH : PATH + WORD] = words / np.maximum(np.sqrt(n), 1)[:, None] * 0.3
    chars = np.array([len(b[0]) for b in flat], dtype=np.float32)
    place = np.concatenate([np.linspace(0, 1, len(p)) for p in page_blocks if p])
    out[:, PATH + WORD :] = np.stack([
        np.log1p(chars) / 5, np.log1p(n) / 4, np.minimum(1, np.array([b[2] for b in flat]) / chars),
        [b[0][-1] in ".!?…:\"'»" for b in flat], np.array([b[0].count(".") + b[0].count(",") for b in flat]) / np.maximum(n, 1) * 3,
        ["©" in b[0] for b in flat], place, np.array([len(p) for p in page_blocks for _ in p]) / 50,
    ], axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = (r.standard_normal((SIZE, 4 * h)) * 0.08).astype(np.float32)
            self.p[f"h{d}"] = (r.standard_normal((h, 4 * h)) * 0.15).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * h, dtype=np.float32)
            self.p[f"c{d}"][h : 2 * h] = 1
        self.p["o"] = (r.standard_normal(2 * h + SIZE) * 0.08).astype(np.float32)
        self.p["e"] = np.zeros(1, dtype=np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        t, b, _ = x.shape
        k = HIDDEN
        z = (x.reshape(t * b, -1) @ self.p[f"x{d}"]).reshape(t, b, -1) + self.p[f"c{d}"]
        h = c = np.zeros((b, k), dtype=np.float32)
        out = np.zeros((t, b, k), dtype=np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[s] + h @ self.p[f"h{d}"]
            i, f, o = _sigmoid(g[:, :k]), _sigmoid(g[:, k : 2 * k]), _sigmoid(g[:, 2 * k : 3 * k])
            u = np.tanh(g[:, 3 * k :])
            m = mask[s][:, None]
            c1 = f * c + i * u
            th = np.tanh(c1)
            if keep is not None:
                keep.append((s, i, f, o, u, c, h, th, m))
            c = m * c1 + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[s] = h
        return out

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        y = np.concatenate([self._pass(x, mask, "f", None), self._pass(x, mask, "b", None), x], axis=2)
        return _sigmoid(y @ self.p["o"] + self.p["e"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        k, g = HIDDEN, {}
        kept = {d: [] for d in "fb"}
        y = np.concatenate([self._pass(x, mask, "f", kept["f"]), self._pass(x, mask, "b", kept["b"]), x], axis=2)
        err = (_sigmoid(y @ self.p["o"] + self.p["e"]) - label) * mask / mask.sum()
        g["o"] = np.tensordot(err, y, axes=([0, 1], [0, 1])) + 1e-5 * self.p["o"]
        g["e"] = np.array([err.sum()], dtype=np.float32)
        for j, d in enumerate("fb"):
            dy = err[:, :, None] * self.p["o"][j * k : (j + 1) * k]
            dz = np.zeros((*mask.shape, 4 * k), dtype=np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            dh = np.zeros((mask.shape[1], k), dtype=np.float32)
            dc = np.zeros_like(dh)
            for s, i, f, o, u, c, h, th, m in reversed(kept[d]):
                dh = dh + dy[s]
                a = dh * m
                dc1 = a * o * (1 - th * th) + dc * m
                z = np.concatenate([dc1 * u * i * (1 - i), dc1 * c * f * (1 - f), a * th * o * (1 - o), dc1 * i * (1 - u * u)], axis=1)
                dz[s] = z
                gh += h.T @ z
                dh = dh * (1 - m) + z @ self.p[f"h{d}"].T
                dc = dc * (1 - m) + dc1 * f
            flat = dz.reshape(-1, 4 * k)
            g[f"x{d}"] = x.reshape(-1, x.shape[2]).T @ flat + 1e-5 * self.p[f"x{d}"]
            g[f"h{d}"], g[f"c{d}"] = gh, flat.sum(axis=0)
        return g


def _padded(vecs: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    t = max(counts)
    x = np.zeros((t, len(counts), SIZE), dtype=np.float32)
    mask = np.zeros((t, len(counts)), dtype=np.float32)
    at = 0
    for b, n in enumerate(counts):
        x[:n, b], mask[:n, b] = vecs[at : at + n], 1
        at += n
    return x, mask


def _words(r: random.Random, n: int) -> str:
    syllables = r.choice((["ka", "lo", "mi", "re", "tun", "vel", "sor", "pa"], ["the", "on", "er", "tion", "st", "ing", "en"], ["ä", "sch", "en", "ung", "ver"], ["é", "aux", "que", "ment"]))
    out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(max(1, n))]
    for i in range(6, len(out), 9):
        out[i] += r.choice((".", ",", ""))
    kind = r.random()  # odd prose, in main text and elsewhere alike
    if kind < 0.1:
        return " | ".join(out)
    if kind < 0.2:
        return " ".join(f"{w}{r.choice(('***', '&&&', '$$$', '!!', '%'))}" for w in out)
    return " ".join(out).upper() if kind < 0.25 else " ".join(out).capitalize()


#: Names of containers in generated pages, by what they hold.
_ROLES = {
    "menu": ("nav menu navbar navigation topbar breadcrumb breadcrumbs tabs toc links", "nav"),
    "head": ("header masthead banner branding top logo", "header"),
    "foot": ("footer foot bottom copyright colophon legal", "footer"),
    "side": ("sidebar side aside widget related recommended trending popular tags secondary", "aside"),
    "note": ("cookie notice consent gdpr alert popup modal overlay paywall message disclaimer", "div"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle", "div"),
    "form": ("form newsletter subscribe signup login search contact", "form"),
    "talk": ("comments comment reply replies discussion responses disqus thread respond", "section"),
    "share": ("share social sharing follow buttons", "div"),
    "main": ("article content main post entry story body text", "article"),
}

#: Names of containers that hold main text and other parts alike, and of further classes that say little.
_AROUND = "page site wrapper wrap container layout root app main content body outer inner row col columns grid single view primary document".split()
_FURTHER = "row col wide box inner area wrap type single item block grid entry standard clearfix large first has dark left right global default public status format template".split()


def _page(r: random.Random) -> list[tuple[str, int]]:
    """Pieces of a page, each with its label: 1 main text, 0 other text, -1 markup only."""
    style = r.choice(("semantic", "named", "both", "both"))

    def around(inner: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """A container that tells nothing of what it holds."""
        tag = r.choice(("div", "div", "div", "section", "main"))
        names = [f'{r.choice(("", "", "site-", "page-"))}{r.choice(_AROUND)}{r.choice(("", "", "-inner", "-wrap"))}' for _ in range(r.randint(1, 2))]
        mark = r.choice(("", f' class="{" ".join(names)}"', f' id="{names[0]}"', f' id="{names[0]}" class="{names[-1]}"'))
        return [(f"<{tag}{mark}>", -1), *inner, (f"</{tag}>", -1)]

    def box(role: str, inner: list[tuple[str, int]]) -> list[tuple[str, int]]:
        names, tag = _ROLES[role]
        words = names.split()
        if style == "semantic" and role not in ("note", "ad", "talk", "share"):
            tag = r.choice((tag, "main")) if role == "main" else tag
            mark = ""
        else:
            tag = tag if style == "both" and r.random() < 0.5 else r.choice(("div", "section", "div"))
            mark = f' {r.choice(("class", "class", "id"))}="{r.choice(("", "site-", "page-", "c-", "box "))}{r.choice(words)}{r.choice(("", "", "-inner", "-box", " wide", "-1", "-area", "-list"))}"'
        return [(f"<{tag}{mark}>", -1), *inner, (f"</{tag}>", -1)]

    def short(label: int, n: tuple[int, int] = (1, 6)) -> tuple[str, int]:
        return (_words(r, r.randint(*n)), label)

    def menu() -> list[tuple[str, int]]:
        out = [("<ul>", -1)]
        for _ in range(r.randint(2, 8)):
            out += [('<li><a href="/x">', -1), short(0, (1, 3)), ("</a></li>", -1)]
        return [*out, ("</ul>", -1)]

    def prose(label: int, n: tuple[int, int] = (1, 4), words: tuple[int, int] = (4, 90), tag: str = "p") -> list[tuple[str, int]]:
        out = []
        for _ in range(r.randint(*n)):
            out += [(f"<{tag}>", -1), (("<b>" if r.random() < 0.2 else "") + _words(r, r.randint(*words)) + r.choice((".", ".", "!", "")), label), (f"</{tag}>" if r.random() < 0.9 else "", -1)]
        return out

    def talk() -> list[tuple[str, int]]:
        out = [("<h3>", -1), (r.choice(("Comments", "3 comments", "Leave a reply", _words(r, 2))), 0), ("</h3>", -1)]
        for _ in range(r.randint(1, 5)):
            out += [(f'<div class="{r.choice(("comment", "reply", "comment-body", "item", "comment-list"))}"><p>', -1), (_words(r, r.randint(2, 70)) + r.choice((".", "")), 0), ("</p></div>", -1)]
        return out

    def form() -> list[tuple[str, int]]:
        return [("<label>", -1), short(0), ('</label><input type="text">', -1), *prose(0, (0, 1), (2, 20))]

    extras = {
        "menu": menu, "head": lambda: [(r.choice(("<h1>", "<div>", "<p>")), -1), short(0), ("</h1></div>", -1), *(menu() if r.random() < 0.3 else [])], "foot": lambda: prose(0, (1, 3), (2, 30)) if r.random() < 0.5 else [("© " + _words(r, r.randint(1, 12)), 0)],
        "side": lambda: [("<h3>", -1), short(0), ("</h3>", -1), *(menu() if r.random() < 0.5 else prose(0, (1, 3), (3, 50)))], "note": lambda: prose(0, (1, 2), (4, 40)), "ad": lambda: prose(0, (1, 2), (2, 30)) if r.random() < 0.5 else [(_words(r, r.randint(2, 25)), 0)],
        "form": form, "talk": talk, "share": menu,
    }
    inner: list[tuple[str, int]] = []
    if r.random() < 0.9:
        inner += [("<h1>", -1), short(1, (2, 12)), ("</h1>", -1)]
    for _ in range(r.randint(6, 30) if r.random() < 0.15 else r.randint(1, 5)):
        lengths = r.choice((((1, 120),), ((1, 120), (1, 3)), ((1, 400), (1, 120), (1, 3)), ((1, 20), (1, 3)), ((30, 200), (1, 2))))
        for _ in range(r.randint(1, 5)):
            inner += prose(1, (1, 1), r.choice(lengths))
        kind = r.random()
        if kind < 0.15:
            inner += [("<h2>", -1), short(1, (1, 8)), ("</h2>", -1)]
        elif kind < 0.25:
            inner += [("<ul>", -1), *prose(1, (2, 5), (2, 25), "li"), ("</ul>", -1)]
        elif kind < 0.32:
            inner += [("<blockquote>", -1), *prose(1, (1, 1), (5, 40)), ("</blockquote>", -1)]
        elif kind < 0.38:
            inner.append(("<table>", -1))
            for _ in range(r.randint(1, 4)):
                inner += [("<tr><td>", -1), short(1), ("</td><td>", -1), short(1, (1, 12)), ("</td></tr>", -1)]
            inner.append(("</table>", -1))
        elif kind < 0.48:
            inner += box(r.choice(("ad", "share", "note", "form", "side")), prose(0, (1, 1), (2, 25)))
    for role, chance in (("share", 0.1), ("talk", 0.2), ("ad", 0.1)):  # at the end of the main container
        if r.random() < chance:
            inner += box(role, extras[role]())
    body: list[tuple[str, int]] = []
    for role, chance in (("note", 0.25), ("head", 0.5), ("menu", 0.8), ("form", 0.2), ("ad", 0.45), ("side", 0.3)):
        if r.random() < chance:
            body += box(role, extras[role]())
    body += box("main", inner)
    for role, chance in (("share", 0.25), ("talk", 0.4), ("side", 0.45), ("ad", 0.3), ("form", 0.25), ("menu", 0.25), ("foot", 0.85), ("note", 0.15)):
        if r.random() < chance:
            body += box(role, extras[role]())
    for _ in range(r.choice((0, 0, 0, 0, 0, 0, 0, 1, 1, 2))):
        body = around(body)
    return body


def training_pages(n: int, seed: int) -> Iterator[tuple[list[tuple[str, Path, int]], list[int]]]:
    """Blocks and labels of generated pages: a mark in each piece of text tells its label through the parser."""
    r = random.Random(seed)
    for _ in range(n):
        page = "".join(f"{text}\x01" if label == 1 else text for text, label in _page(r))
        mark = r.choice(("", "", "", "", f' class="{" ".join(r.sample(_AROUND + _FURTHER, 3))}"'))
        found = [b for b in blocks(f"<html><head><title>x</title></head><body{mark}>{page}</body></html>") if b[0].strip("\x01 ")]
        yield [(b[0].replace("\x01", "").strip(), b[1], b[2]) for b in found], [int("\x01" in b[0]) for b in found]


@lru_cache(maxsize=1)
def trained(pages: int = 900, epochs: int = 14, seed: int = 1) -> Labeller:
    """The labeller, trained with Adam; the same for every call."""
    net, r = Labeller(seed), np.random.default_rng(seed)
    data = list(training_pages(pages, seed))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, total = 0, epochs * -(-pages // 28)
    for _ in range(epochs):
        order = r.permutation(len(data))
        for at in range(0, len(order), 28):
            part = [data[i] for i in order[at : at + 28]]
            x, mask = _padded(vectors([p for p, _ in part]), [len(p) for p, _ in part])
            label = np.zeros_like(mask)
            for b, (_, y) in enumerate(part):
                label[: len(y), b] = y
            x[:, :, :PATH] *= r.random((1, x.shape[1], PATH)) > DROPOUT  # no single name may decide
            step += 1
            rate = 0.012 * (1 - step / (total + 1))
            for k, g in net.gradients(x, mask, label).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


#: Blocks times pages that the network reads at once.
CELLS = 16_384


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(found[order[at + n]]) <= CELLS:
            n += 1
        part = order[at : at + n]
        counts = [len(found[i]) for i in part]
        x, mask = _padded(vectors([found[i] for i in part]), counts)
        keep = net(x, mask) > 0.5
        for b, i in enumerate(part):
            out[i] = " ".join(t for (t, _, _), k in zip(found[i], keep[: counts[b], b].tolist(), strict=True) if k)
        at += n
    return out


@frugal
def _extract(batches: Iterator[pa.RecordBatch], net: Labeller) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = main_texts([t or "" for t in batch.column("html").to_pylist()], net)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url and the main text of every page."""
    return pages.select("page_id", "url", "html").mapInArrow(partial(_extract, net=net or trained()), "page_id long, url string, text string")


def op2(pages: DataFrame) -> DataFrame:
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return extract(slim).withColumn("n_chars", F.char_length("text").cast("long"))
