"""Main text of web pages by a recurrent block labeller (operator 9).

A page is cut into blocks: the text between block-level tags, with character references decoded and white space made single.
Each block is a bag of hashed features: tags, classes and ids of its path from the root, its own words, its length, the share
of its text in links. A bidirectional LSTM, in numpy, reads the blocks of a page in order and labels each as main text or not,
so that every decision sees the whole page. It is trained here, once in a process, on pages that PAGES seeds of a generator
lay out in many ways: menus, headers, footers, sidebars, notices, adverts, forms and reader comments around an article, under
telling and under meaningless names.

Null or empty html gives an empty text. Pages are read whole. Scripts, styles, comments and the head are never blocks.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.llm.shingles import word_hashes
from quillmill.runtime import prepare

FEATURES, WIDTH, HIDDEN, PAGES, EPOCHS, SEED = 4096, 24, 24, 2400, 6, 7
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br path".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Up to their closing tag these hold no markup. Without one the rest of the page is theirs, for those in SWALLOWS.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
SWALLOWS = frozenset("script style".split())
#: What these hold is not text of the page.
UNSEEN = frozenset("template svg object select datalist option optgroup".split())
CHOICES = frozenset("select datalist option optgroup".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@lru_cache(1 << 16)
def _feature(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % (FEATURES // 2)


def blocks(page: str) -> list[tuple[list[str], str, float]]:
    """(path, text, share of characters in links) of every block with text; a path's parts are tags with their names."""
    out: list[tuple[list[str], str, float]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked = total = links = 0
    hidden, unclosed = False, set()

    def flush() -> None:
        nonlocal linked, total
        if text:
            if joined := " ".join(entities.unescape("".join(text)).split()):
                out.append(([p for _, p in stack if p], joined, linked / max(total, 1)))
            text.clear()
        linked = total = 0

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else n
        if stop > at and not hidden:
            text.append(page[at:stop])
            total += stop - at
            linked += (stop - at) * (links > 0)
        if not found:
            break
        at = found.end()
        if not (tag := (found[2] or "").lower()):
            continue
        if tag in RAW:
            if not found[1] and tag not in unclosed:
                if close := re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at):
                    at = close.end()
                elif tag in SWALLOWS:
                    at = n
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            links = max(0, links + (-1 if found[1] else 1))
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            links = 0
        elif tag not in VOID and not (tag in UNSEEN and found[3].endswith("/")):
            while tag in CLOSES_P and stack and stack[-1][0] in CHOICES:
                stack.pop()  # blocks can't stand among choices: these were left open
            if tag in CLOSES_P and stack and stack[-1][0] == "p" or tag in ("li", "tr", "td", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            name = " ".join(m[1].strip("\"'") for m in _NAME.finditer(found[3])).lower() if "=" in found[3] else ""
            stack.append((tag, f"{tag} {name}".strip() if tag not in ("html", "body") else ""))
        hidden = any(t in UNSEEN for t, _ in stack)
    flush()
    return out


Features = tuple[np.ndarray, np.ndarray]


def weighted(own: np.ndarray) -> Features:
    """Feature numbers with weights: what isn't a word counts one over the root of how many there are, and so do words."""
    word = own >= FEATURES // 2
    n = int(np.count_nonzero(word))
    return own, np.where(word, 1 / np.sqrt(max(n, 1)), 1 / np.sqrt(max(len(own) - n, 1))).astype(np.float32)


def features(page: list[tuple[list[str], str, float]]) -> list[Features]:
    """Features of each block: its place, and all its words."""
    hashes, owner, _, _ = word_hashes([text.lower().encode() for _, text, _ in page])
    words = (hashes % np.uint64(FEATURES // 2)).astype(np.int64) + FEATURES // 2
    cuts = np.searchsorted(owner, np.arange(len(page) + 1))
    out = []
    for i, (path, text, share) in enumerate(page):
        found = {_feature("depth", str(min(len(path), 8))), _feature("size", str(min(9, len(text).bit_length()))), _feature("links", str(int(share * 4)))}
        for depth, part in enumerate(path):
            tag, _, names = part.partition(" ")
            found.add(_feature("in", tag))
            if depth == len(path) - 1:
                found.add(_feature("leaf", tag))
            for name in _SPLIT.split(names):
                if name:
                    found.add(_feature("name", name))
        found.add(_feature("end", text[-1] if not text[-1].isalnum() else "a"))
        out.append(weighted(np.concatenate([np.fromiter(found, np.int64, len(found)), words[cuts[i] : cuts[i + 1]]])))
    return out


# The network. Gates are in the order input, forget, output, candidate.


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": rng.standard_normal((FEATURES, WIDTH)).astype(np.float32) * 0.3, "out": draw(2 * HIDDEN + WIDTH), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": draw(WIDTH, 4 * HIDDEN), f"h{way}": draw(HIDDEN, 4 * HIDDEN), f"c{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, pages: list[list[Features]]) -> tuple[np.ndarray, np.ndarray]:
        """(step, page, width) means of the features' vectors, and which are blocks."""
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
        flat = [f for page in pages for f, _ in page]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        share = np.concatenate([w for page in pages for _, w in page])
        sums = np.add.reduceat(self.p["embed"][np.concatenate(flat)] * share[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        at = 0
        for i, page in enumerate(pages):
            x[: len(page), i], mask[: len(page), i] = sums[at : at + len(page)], 1
            at += len(page)
        return x, mask

    def lstm(self, x: np.ndarray, mask: np.ndarray, way: str, keep_trace: bool = True) -> tuple[np.ndarray, list]:
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, trace = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        before = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            gates = before[t] + h @ self.p[f"h{way}"]
            s, g = _sigmoid(gates[:, : 3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            new = f * c + i * g
            act = np.tanh(new)
            keep = mask[t][:, None]
            if keep_trace:
                trace.append((t, h, c, i, f, o, g, act, keep))
            h, c = keep * (o * act) + (1 - keep) * h, keep * new + (1 - keep) * c
            out[t] = h
        return out, trace

    def scores(self, pages: list[list[Features]]) -> list[np.ndarray]:
        """Log odds that each block is main text."""
        x, mask = self.inputs(pages)
        both = np.concatenate([self.lstm(x, mask, "f", False)[0], self.lstm(x, mask, "b", False)[0], x], axis=2)
        z = both @ self.p["out"] + self.p["bias"]
        return [z[: len(page), i] for i, page in enumerate(pages)]

    def gradients(self, pages: list[list[Features]], labels: list[list[int]]) -> tuple[float, dict[str, np.ndarray]]:
        x, mask = self.inputs(pages)
        want = np.zeros_like(mask)
        for i, own in enumerate(labels):
            want[: len(own), i] = own
        (hf, tf), (hb, tb) = self.lstm(x, mask, "f"), self.lstm(x, mask, "b")
        both = np.concatenate([hf, hb, x], axis=2)
        odds = both @ self.p["out"] + self.p["bias"]
        prob = _sigmoid(odds)
        n = mask.sum()
        loss = float((mask * (np.logaddexp(0, odds) - want * odds)).sum() / n)
        dz = (prob - want) * mask / n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["bias"] = np.einsum("tb,tbd->d", dz, both), np.array([dz.sum()], np.float32)
        dboth = dz[:, :, None] * self.p["out"]
        dx = dboth[:, :, 2 * HIDDEN :].copy()
        for way, trace, dout in (("f", tf, dboth[:, :, :HIDDEN]), ("b", tb, dboth[:, :, HIDDEN : 2 * HIDDEN])):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, act, keep in reversed(trace):
                dh = dh + dout[t]
                dnew, dcell = keep * dh, keep * dc
                do = dnew * act
                dcell = dcell + dnew * o * (1 - act * act)
                dgates = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                grad[f"x{way}"] += x[t].T @ dgates
                grad[f"h{way}"] += h.T @ dgates
                grad[f"c{way}"] += dgates.sum(0)
                dx[t] += dgates @ self.p[f"x{way}"].T
                dh, dc = (1 - keep) * dh + dgates @ self.p[f"h{way}"].T, (1 - keep) * dc + dcell * f
        rows = np.concatenate([dx[: len(page), i] for i, page in enumerate(pages)])
        flat = [f for page in pages for f, _ in page]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        share = np.concatenate([w for page in pages for _, w in page])
        np.add.at(grad["embed"], np.concatenate(flat), np.repeat(rows, sizes, axis=0) * share[:, None])
        return loss, grad

    def train(self, pages: list[list[Features]], labels: list[list[int]], epochs: int = EPOCHS, batch: int = 24, rate: float = 4e-3) -> float:
        rng = np.random.default_rng(SEED)
        first, second, step, loss = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, 0.0
        by_size = np.argsort([len(p) for p in pages], kind="stable")
        groups = [by_size[i : i + batch] for i in range(0, len(pages), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                # Most words are left out each time, so that structure is learned first.
                seen = [[weighted(f[(f < FEATURES // 2) | (rng.random(len(f)) < 0.3)]) for f, _ in pages[i]] for i in groups[g]]
                loss, grad = self.gradients(seen, [labels[i] for i in groups[g]])
                step += 1
                for k, d in grad.items():
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.01 * (d * d - second[k])
                    self.p[k] -= rate * (0.5 if epoch >= epochs - 2 else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return loss


# Pages to learn from.

_ROLES = {
    "menu": ["nav", "menu", "navbar", "topnav", "links", "breadcrumb", "breadcrumbs", "pagination", "toc"],
    "header": ["header", "masthead", "top", "logo", "site", "branding"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon"],
    "sidebar": ["sidebar", "aside", "side", "rail", "widget", "related", "recommended", "popular", "trending"],
    "notice": ["notice", "cookie", "consent", "banner", "alert", "gdpr", "popup", "modal", "privacy", "message", "subscribe", "newsletter"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense"],
    "form": ["form", "search", "login", "signup", "contact"],
    "comments": ["comments", "comment", "replies", "reply", "discussion", "responses", "disqus", "reader"],
    "share": ["share", "social", "follow", "tools"],
}
_MAIN = ["article", "content", "main", "post", "entry", "story", "body", "text", "page", "single", "document"]
_TYPICAL = {"notice": "we use cookies to improve accept this site uses", "advert": "advertisement sponsored buy now sale offer", "footer": "copyright all rights reserved terms privacy contact", "comments": "comments reply wrote said great post thanks", "form": "search email name password send submit", "share": "share tweet facebook email print", "menu": "home about news contact", "sidebar": "related popular recent see also", "header": "welcome home login"}


class _Writer:
    """One random page with a label for each of its blocks."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.syllables = ["".join(rng.choice("bcdfghlmnprstvaeiouéèäößñó") for _ in range(rng.randint(1, 3))) for _ in range(40)]
        self.junk = rng.random() < 0.15

    def words(self, least: int, most: int) -> str:
        found = ["".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(least, most))]
        if self.junk:
            found = [w + self.rng.choice(["***", "$$$", "%%%", "###", "&amp;&amp;"]) for w in found]
        found[0] = found[0].capitalize()
        return " ".join(found) + self.rng.choice([".", ".", ".", "", "!", ","])

    def say(self, text: str, label: int, tag: str, attr: str = "") -> None:
        self.out.append(f"<{tag}{attr}>{text}" + ("" if tag == "p" and self.rng.random() < 0.1 else f"</{tag}>"))
        self.labels.append(label)

    def aside(self, role: str) -> None:
        rng = self.rng
        native = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section", "notice": "div", "advert": "div", "share": "div"}[role]
        tag = native if rng.random() < 0.55 else rng.choice(["div", "section", "div"])
        plain = tag in ("nav", "footer", "aside", "form", "header")
        name = rng.choice(_ROLES[role]) if not plain or rng.random() < 0.4 else ""
        if name and rng.random() < 0.3:
            name += rng.choice(["-box", " block", "-1", "_wrap", "-list"])
        attr = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        self.out.append(f"<{tag}{attr}>")
        typical = lambda: " ".join(rng.sample(_TYPICAL[role].split(), 3)) + " " if rng.random() < 0.5 else ""
        if role in ("menu", "share") or role in ("sidebar", "footer") and rng.random() < 0.4:
            self.out.append("<ul>")
            for _ in range(rng.randint(2, 8)):
                self.say(f'<a href="/x">{self.words(1, 3)}</a>', 0, "li")
            self.out.append("</ul>")
        elif role == "comments":
            if rng.random() < 0.5:
                self.say(typical() + self.words(1, 3), 0, "h3")
            for _ in range(rng.randint(1, 6)):
                inner = rng.choice(["p", "div", "li"])
                self.say(typical() + self.words(3, 50), 0, inner, ' class="comment"' if rng.random() < 0.5 else "")
        elif role == "form":
            for _ in range(rng.randint(1, 3)):
                self.say(f"{typical()}{self.words(1, 4)}<input name=q>", 0, rng.choice(["p", "div"]))
            if rng.random() < 0.5:
                self.say(self.words(1, 2), 0, "button")
        elif rng.random() < 0.4:
            self.out.append(f"{typical()}{self.words(4, 25)}")
            self.labels.append(0)
        else:
            for _ in range(rng.randint(1, 3)):
                self.say(typical() + self.words(2, 35), 0, rng.choice(["p", "p", "h4", "div", "span" if False else "p"]))
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        tag, name = rng.choice([("article", ""), ("article", ""), ("article", "m"), ("main", ""), ("div", "m"), ("div", "m"), ("section", "m"), ("div", "")])
        attr = f' {rng.choice(["class", "id"])}="{rng.choice(_MAIN)}{rng.choice(["", "", "-content", " body"])}"' if name else ""
        self.out.append(f"<{tag}{attr}>")
        if rng.random() < 0.85:
            self.say(self.words(2, 12), 1, rng.choice(["h1", "h1", "h2"]))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 25])):
            kind = rng.random()
            if kind < 0.7:
                self.say(self.words(1, 80), 1, "p")
            elif kind < 0.78:
                self.say(f"<b>{self.words(3, 20)}<br>", 1, "p")
            elif kind < 0.86:
                self.say(self.words(1, 8), 1, rng.choice(["h2", "h3"]))
            elif kind < 0.92:
                self.out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.say(self.words(2, 20), 1, "li")
                self.out.append("</ul>")
            elif kind < 0.96:
                self.say(f"{self.words(3, 20)} <a href=x>{self.words(1, 3)}</a> {self.words(3, 20)}", 1, "p")
            elif kind < 0.98:
                self.say(self.words(5, 30), 1, "blockquote")
            else:
                self.aside(rng.choice(["advert", "share", "notice", "sidebar", "form"]))
        self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        before = [r for r in ("header", "menu", "notice", "advert", "form", "sidebar", "share") if rng.random() < 0.4]
        after = [r for r in ("share", "comments", "sidebar", "advert", "form", "notice", "menu") if rng.random() < 0.35]
        rng.shuffle(before)
        wrap = rng.random() < 0.3
        self.out.append(f'<html><head><title>{self.words(1, 5)}</title></head><body>{"<div class=" + rng.choice(["wrapper", "container", "page", "row"]) + ">" if wrap else ""}')
        for role in before:
            self.aside(role)
        self.article()
        for role in after:
            self.aside(role)
        if rng.random() < 0.7:
            self.aside("footer")
        return "".join(self.out), self.labels


def samples(seeds: range) -> tuple[list[list[Features]], list[list[int]]]:
    """Features and labels of generated pages whose blocks are found as they were written."""
    pages, labels = [], []
    for seed in seeds:
        page, own = _Writer(random.Random(seed)).page()
        found = blocks(page)
        if found and len(found) == len(own):
            pages.append(features(found))
            labels.append(own)
    return pages, labels


_trained: list[Labeller] = []


def labeller() -> Labeller:
    """The trained network of this process."""
    if not _trained:
        _trained.append(Labeller())
        _trained[0].train(*samples(range(PAGES)))
    return _trained[0]


#: Steps times pages that the network reads at once; a longer page is read alone.
STEPS = 4096


def main_texts(pages: list[str | None], network: Labeller) -> list[str]:
    cut = [blocks(p or "") for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(cut) if b), key=lambda i: len(cut[i]))
    while order:
        size = 1
        while size < len(order) and size < 48 and (size + 1) * len(cut[order[size]]) <= STEPS:
            size += 1
        some, order = order[:size], order[size:]
        for i, score in zip(some, network.scores([features(cut[i]) for i in some]), strict=True):
            out[i] = " ".join(text for (_, text, _), s in zip(cut[i], score.tolist(), strict=True) if s > 0)
    return out


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df without its html column, with text (string) and n_chars (long) added, which must not be names of its columns.

    Every row is read by itself: repeated rows give the same text each, and an empty table gives no rows.
    """
    from pyspark.sql.types import LongType, StringType, StructType

    prepare(df.sparkSession)
    names = [c for c in df.columns if c != html]
    if clash := {"text", "n_chars"} & set(names):
        raise ValueError(f"columns in use: {sorted(clash)}")
    weights, at = labeller().p, df.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Labeller()
        network.p = weights
        for batch in batches:
            texts = main_texts(batch.column(at).to_pylist(), network)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*names, "text", "n_chars"])

    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name != html]).add("text", StringType()).add("n_chars", LongType()))
