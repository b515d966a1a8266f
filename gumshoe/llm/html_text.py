"""Main text of web pages: a bidirectional LSTM labels the blocks of a page with the whole page in view."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import Recent, map_batches, texts_of

#: The model is fitted on at most so many pages of the table, none longer than so many characters, and
#: on twice as many pages laid out anew from their texts.
SAMPLE_PAGES, SAMPLE_CHARS = 300, 40_000
#: Sizes of the hashed vectors of the tag path and of the words, of other measures, and of one direction's state.
PATH, WORDS, MEASURES, STATE = 128, 64, 6, 24
EPOCHS = 14
#: Padded blocks that the training stacks at a time, and pages labelled at a time.
STACKED, TOGETHER = 4096, 64

# Elements of HTML by how they are laid out.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object title textarea select head".split())
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPES = frozenset("ul ol dl table body html div article section main aside nav header footer form".split())
# Words in names of elements, classes and ids that tell main text from the rest.
BESIDE = frozenset(
    "nav navbar navigation topnav menu header masthead footer copyright bottom aside sidebar side widget related recent popular trending ad ads advert advertisement sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay form login signup search subscribe newsletter share sharing social "
    "breadcrumb breadcrumbs pagination pager comment comments discussion replies reply respond tags toolbar skip".split()
)
MAIN = frozenset("article main content post entry story text body".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...]


def _end_of(html: str, tag: str, at: int) -> int:
    found = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
    return found.end() if found else len(html)


def _named(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role, and a mark if its own attributes hide it."""
    names: list[str] = []
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names += ("." + w for w in _WORD.findall(value.lower()))
        hidden |= name == "hidden" or name == "style" and bool(_NO_DISPLAY.search(value))
    return (*names, "hidden!") if hidden else tuple(names)


def blocks_of(html: str) -> list[Block]:
    """Leaf blocks in page order: text between the tags that break lines, with the open elements and
    their classes, and how many of its characters are links. Character references are decoded and
    white space becomes one blank; scripts, styles, comments and elements with a `hidden` attribute or a
    style of no display give nothing."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked, link_depth, hidden = 0, 0, 0
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not hidden:
                path = tuple(n for o in stack for n in (o.tag, *o.names))
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal hidden
        flush()
        while len(stack) > upto:
            hidden -= "hidden!" in stack.pop().names

    while at < size:
        found = _TOKEN.match(html, at)
        if found is None:
            break
        at = found.end()
        tag = found.group(2)
        if tag is None:
            piece = found.group()
            if not piece.startswith("<") or piece == "<":
                parts.append(piece)
                if link_depth:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if found.group(1):
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag not in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    flush()
                link_depth = 0
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in RAW:
            if tag == "head":
                stop = re.compile(r"</head\s*>|<body\b", re.I).search(html, at)
                if stop:
                    at = stop.start() if stop.group().lower().startswith("<body") else stop.end()
            elif not found.group(3).endswith("/"):
                at = _end_of(html, tag, at)
            continue
        if tag in INLINE:
            link_depth += tag == "a"
            continue
        flush()
        link_depth = 0
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in SIBLINGS.get(tag, ()):
                close(i)
                break
            if stack[i].tag in SCOPES:
                break
        if tag in VOID or found.group(3).endswith("/"):
            continue
        attributes = found.group(3)
        names = _named(attributes) if attributes else ()
        hidden += "hidden!" in names
        stack.append(_Open(tag, names))
    flush()
    return out


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


class Features:
    """Vectors of blocks; those of paths are remembered."""

    def __init__(self):
        self.paths = Recent(self._path)
        self.words = Recent(lambda w: _bucket(w, WORDS))

    @staticmethod
    def _path(path: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(PATH)
        weight = 1.0
        for name in reversed(path):
            out[_bucket(name.lstrip("."), PATH)] += weight
            if not name.startswith("."):
                weight = max(0.4, 0.85 * weight)
        return np.minimum(out, 2.0)

    def __call__(self, blocks: list[Block]) -> np.ndarray:
        x = np.zeros((len(blocks), PATH + WORDS + MEASURES))
        total = sum(len(b.text) for b in blocks)
        seen = 0
        for row, block in zip(x, blocks):
            words = block.text.lower().split()
            row[:PATH] = self.paths[block.path]
            counts = np.bincount([self.words[w] for w in words], minlength=WORDS)
            row[PATH : PATH + WORDS] = np.sqrt(counts) / np.sqrt(len(words))
            n = len(block.text)
            row[PATH + WORDS :] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, block.linked / n, block.text[-1] in ".!?", seen / total, n / total)
            seen += n
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """States (time, page, unit) of an LSTM over inputs (time, page, value); a masked step changes nothing."""
    steps, pages, _ = x.shape
    z = x.reshape(steps * pages, -1) @ w + b
    z = z.reshape(steps, pages, -1)
    h, c = np.zeros((pages, STATE)), np.zeros((pages, STATE))
    out = np.zeros((steps, pages, STATE))
    saved = []
    for t in range(steps):
        g = z[t] + h @ u
        gates = _sigmoid(g[:, : 3 * STATE])
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        n = np.tanh(g[:, 3 * STATE :])
        on = mask[t][:, None]
        new = f * c + i * n
        tc = np.tanh(new)
        if keep:
            saved.append((h, c, i, f, o, n, tc))
        c = np.where(on, new, c)
        h = np.where(on, o * tc, h)
        out[t] = h
    return (out, saved) if keep else out


def _back(x: np.ndarray, mask: np.ndarray, u: np.ndarray, saved: list, dout: np.ndarray):
    """Gradients of an LSTM's weights by back-propagation through time."""
    steps, pages, _ = x.shape
    dz = np.zeros((steps, pages, 4 * STATE))
    du = np.zeros_like(u)
    dh, dc = np.zeros((pages, STATE)), np.zeros((pages, STATE))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, n, tc = saved[t]
        on = mask[t][:, None]
        dh = dh + dout[t]
        live = np.where(on, dh, 0.0)
        dnew = np.where(on, dc, 0.0) + live * o * (1 - tc * tc)
        dz[t] = np.concatenate([dnew * n * i * (1 - i), dnew * c * f * (1 - f), live * tc * o * (1 - o), dnew * i * (1 - n * n)], axis=1)
        du += h.T @ dz[t]
        dh = np.where(on, 0.0, dh) + dz[t] @ u.T
        dc = np.where(on, 0.0, dc) + dnew * f
    flat = dz.reshape(steps * pages, -1)
    return x.reshape(steps * pages, -1).T @ flat, du, flat.sum(axis=0)


@dataclass
class Labeller:
    """Weights of the two directions (input, state, bias) and of the output."""

    weights: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def start(rng: np.random.Generator) -> Labeller:
        width = PATH + WORDS + MEASURES
        out = []
        for _ in range(2):
            bias = np.zeros(4 * STATE)
            bias[STATE : 2 * STATE] = 1.0
            out += [rng.standard_normal((width, 4 * STATE)) * 0.12, rng.standard_normal((STATE, 4 * STATE)) * 0.15, bias]
        return Labeller([*out, rng.standard_normal(2 * STATE) * 0.2, np.zeros(1)])

    @staticmethod
    def stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x = np.zeros((steps, len(pages), PATH + WORDS + MEASURES))
        mask = np.zeros((steps, len(pages)), bool)
        for i, p in enumerate(pages):
            x[: len(p), i] = p
            mask[: len(p), i] = True
        return x, mask

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text of each block; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        w = self.weights
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            x, mask = self.stack([pages[i] for i in some])
            forth = _run(x, mask, *w[:3])
            back = _run(x[::-1], mask[::-1], *w[3:6])[::-1]
            p = _sigmoid(forth @ w[6][:STATE] + back @ w[6][STATE:] + w[7])
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out


def _parts(pages: list[np.ndarray], some: np.ndarray) -> list[list[int]]:
    """Pages of like length together, with at most STACKED padded blocks or one page in a part."""
    out: list[list[int]] = []
    for i in sorted(some, key=lambda i: len(pages[i])):
        if out and len(pages[i]) * (len(out[-1]) + 1) <= STACKED:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _gradients(w: list[np.ndarray], pages: list[np.ndarray], labels: list[np.ndarray], total: int) -> list[np.ndarray]:
    """Gradients of the cross entropy of the pages' blocks, as a share of `total` blocks."""
    x, mask = Labeller.stack(pages)
    y = np.zeros(mask.shape)
    for k, own in enumerate(labels):
        y[: len(own), k] = own
    (forth, saved_f), (back, saved_b) = _run(x, mask, *w[:3], keep=True), _run(x[::-1], mask[::-1], *w[3:6], keep=True)
    states = np.concatenate([forth, back[::-1]], axis=2)
    d = np.where(mask, _sigmoid(states @ w[6] + w[7]) - y, 0.0) / total
    ds = d[:, :, None] * w[6]
    return [
        *_back(x, mask, w[1], saved_f, ds[:, :, :STATE]),
        *_back(x[::-1], mask[::-1], w[4], saved_b, ds[::-1, :, STATE:]),
        (states * d[:, :, None]).sum(axis=(0, 1)),
        d.sum(keepdims=True).ravel()[:1],
    ]


def fit(pages: list[np.ndarray], labels: list[np.ndarray]) -> Labeller:
    """Adam steps on the cross entropy of all blocks; the same input gives the same model."""
    rng = np.random.default_rng(59)
    model = Labeller.start(rng)
    w = model.weights
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    per_epoch = -(-len(pages) // 32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            total = sum(len(labels[i]) for i in some)
            grads = [sum(g) for g in zip(*(_gradients(w, [pages[i] for i in part], [labels[i] for i in part], total) for part in _parts(pages, some)))]
            step += 1
            rate = 1e-2 * (1 - step / (EPOCHS * per_epoch + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            for i, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-12)) + 1e-5 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * m[i] / (np.sqrt(v[i]) + 1e-8)
    return model


def weak_labels(blocks: list[Block]) -> np.ndarray:
    """Labels of a real page from the names of its elements: the rest goes wherever one of them says so,
    main text is what lies in an article or its like, or all paragraphs if the page has none."""
    beside = [any(n.lstrip(".") in BESIDE for n in b.path) for b in blocks]
    main = [any(n.lstrip(".") in MAIN and n != "body" for n in b.path) for b in blocks]
    if not any(m and not s for m, s in zip(main, beside)):
        main = [any(n in ("p", "h1", "h2", "blockquote", "pre") for n in b.path) for b in blocks]
    return np.array([m and not s for m, s in zip(main, beside)], float)


def laid_out(rng: np.random.Generator, texts: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page made of given texts in a layout drawn at random, with the label of every block."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    chance = lambda p: rng.random() < p
    good, rest = chr(0xE000), chr(0xE001)  # private marks of main text and of the rest

    def text(mark: str, most: int = 60) -> str:
        words = pick(*texts).split()
        n = int(min(len(words), 1 + rng.exponential(most / 2)))
        at = int(rng.integers(len(words) - n + 1))
        return mark + " ".join(words[at : at + n])

    def links(mark: str, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{text(mark, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def box(tag: str, name: str, inner: str) -> str:
        kind = pick("class", "id")
        return f"<{tag} {kind}={name!r}>{inner}</{tag}>" if name else f"<{tag}>{inner}</{tag}>"

    def aside_part() -> str:
        kind = pick("ad", "side", "notice", "form", "share", "related", "menu")
        if kind == "ad":
            return box("div", pick("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "ad-slot"), pick("", "<p>") + text(rest, 30))
        if kind == "side":
            return box(*pick(("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("section", "side")), f"<h3>{text(rest, 4)}</h3>" + pick(links(rest, 4), f"<p>{text(rest, 40)}</p>"))
        if kind == "notice":
            return box("div", pick("notice", "cookie", "cookie-notice", "alert", "consent", "gdpr", "popup", "cookie-banner"), f"<p>{text(rest, 30)}</p>" + pick("", f"<button>{text(rest, 2)}</button>"))
        if kind == "form":
            return box("form", pick("", "search", "login", "subscribe", "newsletter"), f"<p>{text(rest, 20)}</p><label>{text(rest, 3)}</label><input><button>{text(rest, 2)}</button>")
        if kind == "share":
            return box("div", pick("share", "social", "tags", "breadcrumb", "pagination"), links(rest, 3))
        if kind == "related":
            return box(pick("div", "section"), pick("related", "recent", "popular", "related-posts"), f"<h2>{text(rest, 4)}</h2>" + links(rest, 4))
        return box(*pick(("nav", ""), ("div", "menu"), ("div", "navbar"), ("nav", "navigation"), ("ul", "menu")), links(rest, 5))

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.75:
            return "<p>" + pick("", "", "<b>") + text(good, 90) + pick("</p>", "</p>", "</p>", "<br>")
        if kind < 0.83:
            return f"<h2>{text(good, 6)}</h2>"
        if kind < 0.89:
            return "<ul>" + "".join(f"<li>{text(good, 14)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.93:
            return f"<blockquote><p>{text(good, 40)}</p></blockquote>"
        if kind < 0.96:
            return f"<pre>{text(good, 20)}</pre>"
        return f"<table><tr><td>{text(good, 4)}<td>{text(good, 4)}</tr></table>"

    body = []
    if chance(0.5):
        body.append(box(*pick(("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead")), pick(f"<h1>{text(rest, 4)}</h1>", f"<p>{text(rest, 10)}</p>") + pick("", f"<nav>{links(rest, 4)}</nav>")))
    if chance(0.7):
        body.append(box(*pick(("nav", ""), ("div", "menu"), ("div", "topnav")), links(rest, int(rng.integers(3, 8)))))
    body += [aside_part() for _ in range(int(rng.integers(0, 4)))]
    inner = [f"<h1>{text(good, 10)}</h1>"] if chance(0.8) else []
    for _ in range(int(1 + rng.exponential(6))):
        inner.append(paragraph())
        if chance(0.05):
            inner.append(aside_part())
    content = "".join(inner)
    content = box(*pick(("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry"), ("div", "story"), ("section", "main")), content)
    if chance(0.3):
        content = box("div", pick("main", "page", "container", "wrapper", "layout"), content + (aside_part() if chance(0.4) else ""))
    body.append(content)
    if chance(0.45):
        said = "".join(box("div", pick("comment", "reply", "comment-body"), f"<p>{text(rest, 40)}</p>" * int(rng.integers(1, 3))) for _ in range(int(rng.integers(1, 5))))
        body.append(box(pick("section", "div", "ol"), pick("comments", "comment-list", "discussion", "replies"), pick("", f"<h2>{text(rest, 3)}</h2>") + said))
    body += [aside_part() for _ in range(int(rng.integers(0, 3)))]
    if chance(0.8):
        body.append(box(*pick(("footer", ""), ("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "site-footer")), pick(f"<p>{text(rest, 20)}</p>", "&copy; " + text(rest, 14), links(rest, 3))))
    blocks = blocks_of("<html><body>" + "".join(body) + "</body></html>")
    labels = np.array([good in b.text for b in blocks], float)
    for b in blocks:
        b.text = " ".join(b.text.replace(good, "").replace(rest, "").split()) or "-"
        b.linked = min(b.linked, len(b.text))
    return blocks, labels


def fit_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """Fit on the pages whose id's hash is lowest, and on their texts laid out anew."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).filter(F.length("html").between(1, SAMPLE_CHARS))
    # The ids first: every task sends its candidates, which should be numbers, not pages.
    order = F.xxhash64("page_id"), "page_id"
    ids = rows.select("page_id").distinct().orderBy(*order).limit(SAMPLE_PAGES)
    chosen = rows.join(F.broadcast(ids), "page_id").dropDuplicates(["page_id", "html"])
    sample = [r["html"] for r in chosen.orderBy(*order, "html").limit(SAMPLE_PAGES).collect()]
    features, inputs, labels, texts = Features(), [], [], []
    for html in sample:
        blocks = blocks_of(html)
        if blocks:
            texts += [b.text for b in blocks]
            inputs.append(features(blocks).astype(np.float32))
            labels.append(weak_labels(blocks))
    texts = texts or ["Some words that stand for a text. They say nothing, but they have the shape of one."]
    rng = np.random.default_rng(61)
    for _ in range(2 * SAMPLE_PAGES):
        blocks, own = laid_out(rng, texts)
        if blocks:
            inputs.append(features(blocks).astype(np.float32))
            labels.append(own)
    return fit(inputs, labels)


def extract_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, blocks) for each row: the blocks labelled as main text, in page
    order with two line breaks between them, and every block's text and probability.

    The model, of fixed size, is broadcast; pages are parsed and labelled in small batches where they
    are read, each as a whole whatever its length. A null or empty page, and one without main text,
    has an empty text of 0 characters; repeated rows, null ids and null addresses are kept; no rows
    give no rows; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller, features = shared.value, Features()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parsed = [blocks_of(h) for h in texts_of(batch.column(2))]
            chances = labeller.probabilities([features(b) if b else np.zeros((0, PATH + WORDS + MEASURES)) for b in parsed])
            texts = ["\n\n".join(b.text for b, p in zip(bs, ps) if p >= 0.5) for bs, ps in zip(parsed, chances)]
            kind = pa.list_(pa.struct([("text", pa.string()), ("chance", pa.float64())]))
            blocks = [[{"text": b.text, "chance": float(p)} for b, p in zip(bs, ps)] for bs, ps in zip(parsed, chances)]
            return pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, kind)],
                names=["page_id", "url", "text", "n_chars", "blocks"],
            )

        return step

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_batches(rows, make, "page_id bigint, url string, text string, n_chars bigint, blocks array<struct<text:string,chance:double>>")
