"""Main text of web pages: a recurrent labeller over the leaf blocks of a page."""

from __future__ import annotations

import html as html_lib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed tag-path and word vectors; further features are length, linked share and place.
PATH_BUCKETS, WORD_BUCKETS, MORE = 512, 32, 4
FEATURES = PATH_BUCKETS + WORD_BUCKETS + MORE
HIDDEN = 16
#: Pages whose words fill the training pages (those with the smallest id hashes), training pages, passes.
SAMPLE_PAGES, TRAINING_PAGES, PASSES = 100, 600, 10
#: Words of each block of a sampled page that may fill the training pages; extraction reads whole blocks.
BLOCK_WORDS = 400
#: Pages labelled together, and steps x pages (padding included) whose features are held at once.
TOGETHER, CELLS = 128, 16_384

INLINE = frozenset(
    "a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>"']*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|[^<]+""", re.S)
_OPENS = re.compile(r"</?[A-Za-z]")
#: A tag whose quotes are not closed ends at the next ``>`` whatever stands before it.
_BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
_MARK = re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Where a raw element ends; only ASCII letters have two cases here.
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


class Path:
    """Words (tags and words of class, id and role) from the page down to an element, held as a link to the
    element around it; ``mask`` has a bit for each bucket of any of them, so no depth makes it larger."""

    __slots__ = ("around", "names", "mask")

    def __init__(self, around: Path | None, names: tuple[str, ...]):
        self.around, self.names = around, names
        self.mask = around.mask if around is not None else 0
        for word in names:
            self.mask |= 1 << _WORDS["<" + word] % PATH_BUCKETS

    def __iter__(self) -> Iterator[str]:
        links, at = [], self
        while at is not None:
            links.append(at.names)
            at = at.around
        return (w for names in reversed(links) for w in names)


@dataclass
class Block:
    """A leaf: its path, its text and how much of it is linked."""

    path: Path
    text: str
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        out += [w.lower() for w in _NAME.findall(m[1] or m[2] or m[3] or "")]
    return tuple(out)


class _Tokens:
    """The tokens of a page from a place on. Whether a tag's quotes close is looked up, not scanned for each
    tag anew, once one did not: so a page of tags without an end costs no more than its length."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.marks: list[int] | None = None
        self.closes: list[bool] = []

    def _closes(self, at: int) -> bool:
        """Whether a ``>`` outside quotes follows ``at``, which is outside quotes."""
        if self.marks is None:
            self.marks = [m.start() for m in _MARK.finditer(self.page)]
            self.closes, later = [False] * (len(self.marks) + 1), {}
            for i in range(len(self.marks) - 1, -1, -1):
                mark = self.page[self.marks[i]]
                self.closes[i] = mark == ">" or mark in later and self.closes[later[mark] + 1]
                later[mark] = i
        return self.closes[bisect_left(self.marks, at)]

    def at(self, at: int) -> tuple[int, re.Match | None]:
        """(end, match) of the token at ``at``; without a match it is text."""
        page = self.page
        if page[at] == "<" and not page.startswith("<!--", at):
            if at > self.last:  # no tag ends any more
                end = page.find("<!--", at)
                return (len(page) if end < 0 else end), None
            if self.marks is not None and _OPENS.match(page, at) and not self._closes(at):
                m = _BROKEN.match(page, at)
                return m.end(), m
        m = _TOKEN.match(page, at)
        if m is None and _OPENS.match(page, at) and not self._closes(at):
            m = _BROKEN.match(page, at)
        return (at + 1, None) if m is None else (m.end(), m if page[at] == "<" else None)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: text between tags that are not inline, with white space made
    single blanks and character references decoded. Unclosed elements end with their parent; a paragraph
    ends where the next block starts; a tag with an open quote ends at the next ``>``; without any ``>``
    left, ``<`` is text. The work follows the page's length, whatever is broken and however deep it nests."""
    out: list[Block] = []
    root = Path(None, ())
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    path = root
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
        if text:
            out.append(Block(path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    page = page or ""
    at, size = 0, len(page)
    tokens = _Tokens(page)
    while at < size:
        start = at
        at, m = tokens.at(start)
        if m is None:
            parts.append(page[start:at])
            if links:
                linked += at - start
            continue
        tag = m[2]
        if tag is None:  # a comment or declaration
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m[1] else 1))
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if m[1]:
            if opened[tag]:
                while True:
                    name, _ = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
        elif tag in RAW:
            if m[3].endswith("/"):
                continue
            close = _RAW_ENDS[tag].search(page, at)
            at = size if close is None else close.start()
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        elif tag not in VOID and not m[3].endswith("/"):
            if stack and stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1
            if stack and tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1
            stack.append((tag, Path(stack[-1][1] if stack else root, (tag, *_names(m[3])))))
            opened[tag] += 1
        links = 0
        path = stack[-1][1] if stack else root
    flush()
    return out


class _Buckets(dict):
    """Hash of a word, kept."""

    def __missing__(self, word: str) -> int:
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Buckets()
_PATHS: dict[int, np.ndarray] = {}


def features(page: Sequence[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row per block (of those from ``start`` to ``stop``): hashed path, hashed words, length, linked share, place."""
    some = page[start:stop]
    out = np.zeros((len(some), FEATURES), np.float32)
    if len(_WORDS) > 500_000:
        _WORDS.clear()
    for i, block in enumerate(some):
        mask = block.path.mask
        if mask not in _PATHS:
            if len(_PATHS) > 50_000:
                _PATHS.clear()
            _PATHS[mask] = np.array([k for k in range(PATH_BUCKETS) if mask >> k & 1], np.int64)
        out[i, _PATHS[mask]] = 1
        words = block.text.lower().split(" ")
        hashed = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words)) % WORD_BUCKETS
        out[i, PATH_BUCKETS:PATH_BUCKETS + WORD_BUCKETS] = np.bincount(hashed, minlength=WORD_BUCKETS) / len(words)
        out[i, -MORE:] = (np.log1p(len(block.text)) / 8, block.linked / len(block.text), (start + i) / len(page), 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """A bidirectional LSTM with one logistic output per step, in numpy."""

    def __init__(self, inputs: int = FEATURES, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden, self.p = hidden, {}
        for d in "fb":
            self.p[d + "x"] = rng.normal(0, 0.1, (inputs, 4 * hidden))
            self.p[d + "h"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            self.p[d + "c"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p["o"], self.p["ob"] = rng.normal(0, 0.2, 2 * hidden), np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool,
             state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """States of one direction, in the order of time; with what the gradient needs if ``keep``; the last
        state, from which the steps that follow in this direction go on."""
        steps, n, size = x.shape[0], x.shape[1], self.hidden
        given = (x.reshape(steps * n, -1) @ self.p[d + "x"] + self.p[d + "c"]).reshape(steps, n, -1)
        h, c = state or (np.zeros((n, size), np.float32), np.zeros((n, size), np.float32))
        out, kept = np.zeros((steps, n, size), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[d + "h"]
            gates = _sigmoid(z[:, :3 * size])
            i, f, o, g = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:], np.tanh(z[:, 3 * size:])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tanh, m))
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, kept, (h, c)

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], 2)
        return _sigmoid(states @ self.p["o"] + self.p["ob"])

    def predict_pages(self, pages: Sequence[Sequence[Block]]) -> np.ndarray:
        """``predict`` of the features of the pages, made for slices of CELLS cells. The states of both
        directions go on from slice to slice; what is kept of a step is one number."""
        longest, size = max(len(p) for p in pages), self.hidden
        steps = max(1, CELLS // len(pages))
        if longest <= steps:
            return self.predict(*padded([features(p) for p in pages]))
        scores = np.zeros((longest, len(pages)), np.float32)
        starts = range(0, longest, steps)
        for k, d in enumerate("fb"):
            state = None
            for start in starts if d == "f" else reversed(starts):
                x, mask = padded([features(p, start, start + steps) for p in pages])
                out, _, state = self._run(d, x, mask, False, state)
                scores[start:start + len(out)] += out @ self.p["o"][k * size:(k + 1) * size]
        return _sigmoid(scores + self.p["ob"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the steps in the mask."""
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        error = (_sigmoid(states @ self.p["o"] + self.p["ob"]) - y) * mask / mask.sum()
        grad = {"o": np.einsum("tn,tnh->h", error, states), "ob": np.array([error.sum()])}
        size = self.hidden
        for k, d in enumerate("fb"):
            weights = self.p["o"][k * size:(k + 1) * size]
            dz_all = np.zeros((*x.shape[:2], 4 * size), np.float32)
            dh, dc, gh = np.zeros((x.shape[1], size)), np.zeros((x.shape[1], size)), np.zeros_like(self.p[d + "h"])
            for t, h, c, i, f, o, g, tanh, m in reversed(runs[d][1]):
                dh = dh + error[t][:, None] * weights
                own, cell = dh * m, dc * m
                cell = cell + own * o * (1 - tanh * tanh)
                dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), own * tanh * o * (1 - o), cell * i * (1 - g * g)], 1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = dh * (1 - m) + dz @ self.p[d + "h"].T
                dc = dc * (1 - m) + cell * f
            flat = dz_all.reshape(-1, 4 * size)
            grad |= {d + "x": x.reshape(len(flat), -1).T @ flat, d + "h": gh, d + "c": flat.sum(0)}
        return grad


def padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, features) and the mask of real steps."""
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), FEATURES), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, 1
    return x, mask


# Elements and class words that training pages are made of.
MAIN_FRAMES = (
    '<article>', '<main>', '<main><article>', '<div class="content">', '<div id="main-content">', '<div class="post"><div class="entry-content">',
    '<section class="article-body">', '<div class="story">', '<div role="main">', '<article class="post"><div class="body text">', '<div id="article">', '')
MENUS = ('<nav>', '<div class="menu">', '<div id="navbar">', '<header><nav>', '<ul class="breadcrumb">', '<div class="pagination">', '<nav class="main-nav">')
HEADERS = ('<header>', '<div class="header">', '<div id="masthead">', '<div class="site-header top">')
FOOTERS = ('<footer>', '<div class="footer">', '<div id="copyright">', '<div class="site-footer bottom">')
SIDES = ('<aside>', '<div class="sidebar">', '<div class="widget">', '<div class="related">', '<div id="recent-posts">', '<div class="tags">', '<aside class="side">')
NOTICES = (
    '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="banner">', '<div class="sponsored">', '<div class="promo">',
    '<div class="cookie">', '<div class="cookie-notice">', '<div class="notice">', '<div class="alert">', '<div class="popup">', '<div class="newsletter">',
    '<div class="subscribe">', '<div class="consent gdpr">', '<div class="share">', '<div class="social">', '<div class="paywall">', '<dialog>', '<div id="ad-1">')
FORMS = ('<form>', '<form class="search">', '<form id="login">', '<div class="contact"><form>')
COMMENTS = ('<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">', '<div id="disqus" class="discussion">',
            '<div class="reviews">', '<div class="replies">', '<section class="reader-comments">')


def training_pages(words: Sequence[str], count: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of random layout with the label of each block (1: main text), filled with the given words.

    The words are the same on both sides, so the labels follow from paths, lengths, links and context.
    """
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    words = list(words) or ["word"]

    def text(low: int, high: int) -> str:
        n = int(np.exp(rng.uniform(np.log(low), np.log(high))))
        return html_lib.escape(" ".join(words[i] for i in rng.integers(len(words), size=n)))

    def close(frame: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", frame)))

    def junk(kind: tuple[str, ...]) -> tuple[str, int]:
        frame, inner, n = pick(kind), "", 0
        if kind is MENUS:
            n = int(rng.integers(2, 9))
            item = "<li>{}</li>" if rng.random() < 0.7 else "<div>{}</div>"
            inner = "".join(item.format(f'<a href="/x">{text(1, 3)}</a>') for _ in range(n))
            inner = f"<ul>{inner}</ul>" if rng.random() < 0.7 else inner
        elif kind is FORMS:
            n = int(rng.integers(1, 4))
            inner = "".join(f"<label>{text(1, 4)}</label><input>" for _ in range(n)) + "<button></button>"
        elif kind is COMMENTS:
            n = int(rng.integers(1, 6))
            inner = "".join(f"<{(t := pick(('p', 'div', 'li')))}>{text(3, 120)}</{t}>" for _ in range(n))
        elif rng.random() < 0.5:
            n, inner = 1, text(2, 60)
        else:
            n = int(rng.integers(1, 4))
            inner = "".join(f"<{(t := pick(('p', 'div', 'h3', 'span></span><p')))}>{text(2, 60)}</{'p' if 'span' in t else t}>" for _ in range(n))
        return frame + inner + close(frame), n

    out = []
    for _ in range(count):
        page, labels = ["<html><head><title>t</title></head><body>"], []

        def add(markup: str, n: int, label: int) -> None:
            page.append(markup)
            labels.extend([label] * n)

        for kind, chance in ((NOTICES, 0.3), (HEADERS, 0.4), (MENUS, 0.8), (NOTICES, 0.5), (SIDES, 0.2)):
            if rng.random() < chance:
                add(*junk(kind), 0)
        frame = pick(MAIN_FRAMES) if rng.random() < 0.6 else "<article>"
        page.append(frame)
        if rng.random() < 0.8:
            add(f"<h1>{text(2, 14)}</h1>", 1, 1)
        for _ in range(int(np.exp(rng.uniform(0, 3.4)))):
            roll = rng.random()
            if roll < 0.72:
                add(f"<p>{'<b>' * (rng.random() < 0.2)}{text(1, 250)}{pick(('</p>', '<br>', ''))}", 1, 1)
            elif roll < 0.80:
                add(f"<h2>{text(1, 10)}</h2>", 1, 1)
            elif roll < 0.85:
                n = int(rng.integers(1, 6))
                add("<ul>" + "".join(f"<li>{text(1, 30)}</li>" for _ in range(n)) + "</ul>", n, 1)
            elif roll < 0.88:
                add(f"<blockquote>{text(4, 60)}</blockquote>", 1, 1)
            elif roll < 0.91:
                n = int(rng.integers(1, 5))
                add("<table><tr>" + "".join(f"<td>{text(1, 8)}</td>" for _ in range(n)) + "</tr></table>", n, 1)
            elif roll < 0.93:
                add(f"<p>{text(2, 30)} <a href='/y'>{text(1, 4)}</a> {text(2, 30)}</p>", 1, 1)
            elif frame:
                add(*junk(pick((NOTICES, SIDES, NOTICES))), 0)
        if frame and rng.random() < 0.15:
            add(*junk(COMMENTS), 0)
        page.append(close(frame))
        for kind, chance in ((COMMENTS, 0.35), (FORMS, 0.3), (SIDES, 0.35), (NOTICES, 0.2), (FOOTERS, 0.9)):
            if rng.random() < chance:
                add(*junk(kind), 0)
        out.append(("".join(page), labels))
    return out


def train(words: Sequence[str], passes: int = PASSES) -> BiLstm:
    """A labeller trained on made pages with Adam; equal words give an equal model."""
    made = [(features(b), labels) for page, labels in training_pages(words) if len(b := blocks(page)) == len(labels) > 0]
    made.sort(key=lambda x: len(x[1]))
    model, rng, step = BiLstm(), np.random.default_rng(3), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    groups = [made[i:i + 16] for i in range(0, len(made), 16)]
    for turn in range(passes):
        for i in rng.permutation(len(groups)):
            x, mask = padded([f for f, _ in groups[i]])
            y = np.zeros_like(mask)
            for j, (_, labels) in enumerate(groups[i]):
                y[:len(labels), j] = labels
            step += 1
            rate = 0.02 if turn < passes - 2 else 0.005
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                update = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                model.p[k] = (model.p[k] - update).astype(np.float32)
    return model


def main_text(pages: Sequence[str | None], model: BiLstm) -> list[str]:
    """Main text of each page: its blocks labelled as main, joined by line ends."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    start = 0
    while start < len(order):
        # As many pages as fit when padded to the longest, one at least.
        stop = start + 1
        while stop < len(order) and stop - start < TOGETHER and (stop + 1 - start) * len(found[order[stop]]) <= CELLS:
            stop += 1
        some = order[start:stop]
        chance = model.predict_pages([found[i] for i in some])
        for j, i in enumerate(some):
            out[i] = "\n".join(b.text for b, c in zip(found[i], chance[:, j], strict=False) if c >= 0.5)
        start = stop
    return out


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES,
                 block_words: int = BLOCK_WORDS) -> BiLstm:
    """Train on words of ``sample`` pages (the smallest id hashes), the first ``block_words`` of each block; the driver
    reads no more than these pages."""
    known = pages.filter(F.col(html_col).isNotNull() & F.col(id_col).isNotNull())
    # Ids first: tasks send the least ids alone, not pages.
    ids = [r[0] for r in known.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
    rows = known.filter(F.col(id_col).isin(ids)).select(html_col).limit(sample).collect()
    words = sorted({w for r in rows for b in blocks(r[0]) for w in b.text.split(" ")[:block_words]})
    return train(words)


def extract_pages(pages: DataFrame, model: BiLstm | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page; the text is empty if nothing is labelled main.

    A null or empty page has an empty text; repeated rows give equal rows; a null id or url is kept; an empty
    table gives an empty result; broken markup is read as far as it goes; other columns are ignored.
    """
    model = model or fit_labeller(pages, id_col, html_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for start in range(0, rows.num_rows, 512):
                part = rows.slice(start, 512)
                texts = main_text(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    fed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return fed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
