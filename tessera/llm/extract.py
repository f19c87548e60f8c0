"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks.  Each block is a vector of its
hashed tag path, its hashed words and a few measures; a bidirectional LSTM in
numpy reads the whole sequence, and a logistic output labels every block.  The
network is trained here, on a bounded sample of the pages: their blocks are
labelled by the elements they stand in, and each sampled page is also rebuilt
under other templates (other containers, sidebars, notices, forms, comments),
so that the labels depend on the path and on what stands around a block rather
than on one site's markup.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import Block, leaf_blocks
from tessera.llm.words import Words

#: buckets of path tokens and of words, measures, units per direction
PATHS, WORDS, MEASURES, UNITS = 192, 32, 6, 16
#: pages of the training sample, rebuilt pages (at least, however few are sampled), passes
SAMPLE, REBUILT, EPOCHS = 200, 1000, 8
#: pages labelled together
ROWS = 64

#: Element names and class words that hold the article, or something else.
MAIN = frozenset("article main .article .content .post .entry .story .body .text".split())
OTHER = frozenset("nav header footer aside form title button dialog .nav .menu .header .footer .aside .sidebar .widget .ad .ads .advert "
                  ".advertisement .banner .promo .sponsor .cookie .cookies .notice .alert .comment .comments .reply .respond .share .social "
                  ".related .breadcrumb .breadcrumbs .pagination .newsletter .subscribe .login .search .copyright .masthead".split())
#: Templates of rebuilt pages.
MAIN_FRAMES = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content"), ("div", ".post"),
               ("section", ".article"), ("div", ".entry", ".content"), ("div", ".story"), ("div", ".article", ".body"),
               ("div",), ("div", "div"), ("section",), ("table", "tr", "td"), ("table", "tbody", "tr", "td", "article"),
               ("table", "tbody", "tr", "td", "div", ".content"), ("body", "center", "table", "tr", "td"))
OTHER_FRAMES = (("nav",), ("nav", "ul", "li"), ("header",), ("div", ".header"), ("div", ".menu"), ("ul", ".nav", "li"), ("footer",), ("div", ".footer"),
                ("aside",), ("div", ".sidebar"), ("div", ".widget"), ("div", ".ad"), ("div", ".advert"), ("div", ".banner"), ("div", ".promo"),
                ("div", ".cookie", ".notice"), ("div", ".notice"), ("form",), ("div", ".subscribe", "form"), ("div", ".newsletter"),
                ("section", ".comments"), ("div", ".comments", "div", ".comment"), ("ol", ".comments", "li", ".comment"), ("div", ".related"),
                ("div", ".share"), ("div", ".breadcrumb"), ("div", ".copyright"), ("table", "tr", "td", ".sidebar"), ("table", "tr", "td", ".menu"),
                ("table", "tr", "td", "form"), ("section", ".related"), ("div", "div", ".ad"))
#: Elements that a block may stand in, in an article and elsewhere.
LEAVES = (("h2",), ("h3",), ("h4",), ("h5",), ("ul", "li"), ("ol", "li"), ("li", "p"), ("table", "tr", "td"), ("table", "tbody", "tr", "th"), ("pre",),
          ("blockquote",), ("blockquote", "p"), ("figure", "figcaption"), ("dl", "dt"), ("dl", "dd"), ("div",), ("div", "p"), ("section", "p"),
          ("details", "summary"), ("address",), ())


def _bucket(token: str, size: int, salt: int) -> int:
    h = salt
    for b in token.encode():
        h = (h * 1_000_003 ^ b) & 0xFFFFFFFF
    return (h ^ h >> 15) % size


@lru_cache(maxsize=50_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tokens of a path; the last element counts on its own as well."""
    v = np.zeros(PATHS, np.float32)
    half = PATHS // 2
    for t in set(path):
        v[_bucket(t, half, 17)] += 1
        v[half + _bucket(t, half, 91)] += 1
    return v


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), PATHS + WORDS + MEASURES), np.float32)
    if not flat:
        return x
    x[:, :PATHS] = [path_vector(b.path) for b in flat]
    w = Words(pa.array([b.text for b in flat], pa.large_string()), lower=True)
    n = np.diff(w.first).astype(np.float32)
    row = w.row_of()
    cells = np.bincount(row * WORDS + (w.hash % np.uint64(WORDS)).astype(np.int64), minlength=len(flat) * WORDS)
    x[:, PATHS:PATHS + WORDS] = cells.reshape(len(flat), WORDS) / np.maximum(n, 1)[:, None]
    size = np.array([len(b.text) for b in flat], np.float32)
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages if p])
    ends = np.array([b.text[-1] in ".!?…。" for b in flat], np.float32)
    x[:, -MEASURES:] = np.column_stack([np.log1p(size) / 8, np.log1p(n) / 6, [b.linked for b in flat], ends, place, np.ones(len(flat))])
    return x


class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    def __init__(self, inputs: int, units: int, rng):
        self.wx = (rng.standard_normal((inputs, 4 * units)) / np.sqrt(inputs)).astype(np.float32)
        self.wh = (rng.standard_normal((units, 4 * units)) / np.sqrt(units)).astype(np.float32)
        self.b = np.zeros(4 * units, np.float32)
        self.b[units:2 * units] = 1
        self.units = units

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """``x`` (time, page, input) → states (time, page, unit)."""
        steps, pages, u = x.shape[0], x.shape[1], self.units
        z = (x.reshape(-1, x.shape[2]) @ self.wx + self.b).reshape(steps, pages, 4 * u)
        h, c = np.zeros((pages, u), np.float32), np.zeros((pages, u), np.float32)
        out, tape = np.zeros((steps, pages, u), np.float32), []
        for t in range(steps):
            g = z[t] + h @ self.wh
            gates = 1 / (1 + np.exp(-np.clip(g[:, :3 * u], -30, 30)))
            i, f, o = gates[:, :u], gates[:, u:2 * u], gates[:, 2 * u:]
            d = np.tanh(g[:, 3 * u:])
            m = mask[t][:, None]
            new_c = m * (f * c + i * d) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                tape.append((h, c, i, f, o, d, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out, tape

    def backward(self, x: np.ndarray, tape, grad: np.ndarray):
        """Gradients of wx, wh and b for ``grad`` (of the states)."""
        steps, pages, u = grad.shape
        dz = np.zeros((steps, pages, 4 * u), np.float32)
        dh, dc = np.zeros((pages, u), np.float32), np.zeros((pages, u), np.float32)
        dwh = np.zeros_like(self.wh)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, d, tc, m = tape[t]
            dh = dh + grad[t]
            a = dh * m
            dcell = dc + a * o * (1 - tc * tc)
            e = dcell * m
            dz[t] = np.concatenate([e * d * i * (1 - i), e * c * f * (1 - f), a * tc * o * (1 - o), e * i * (1 - d * d)], 1)
            dwh += h.T @ dz[t]
            dh = dz[t] @ self.wh.T + dh * (1 - m)
            dc = e * f + dcell * (1 - m)
        flat = dz.reshape(-1, 4 * u)
        return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        inputs = PATHS + WORDS + MEASURES
        self.ahead, self.back = Lstm(inputs, UNITS, rng), Lstm(inputs, UNITS, rng)
        self.w = (rng.standard_normal(2 * UNITS) / np.sqrt(2 * UNITS)).astype(np.float32)
        self.b = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.wx, self.ahead.wh, self.ahead.b, self.back.wx, self.back.wh, self.back.b, self.w, self.b]

    @staticmethod
    def padded(pages: list[np.ndarray]):
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), PATHS + WORDS + MEASURES), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for i, p in enumerate(pages):
            x[:len(p), i], mask[:len(p), i] = p, 1
        return x, mask

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each block of each page to be main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for s in range(0, len(order), 32):
            part = order[s:s + 32]
            x, mask = self.padded([pages[i] for i in part])
            a, _ = self.ahead.forward(x, mask)
            # padding stands at the end: the backward pass starts in it and the mask holds its state at zero
            b, _ = self.back.forward(x[::-1], mask[::-1])
            z = np.concatenate([a, b[::-1]], 2) @ self.w + self.b[0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            for k, i in enumerate(part):
                out[i] = p[:len(pages[i]), k]
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the log loss, batches of pages of about one length."""
        rng = np.random.default_rng(seed)
        use = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        batches = [use[i:i + 16] for i in range(0, len(use), 16)]
        params = self.parameters()
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                part = batches[k]
                x, mask = self.padded([pages[i] for i in part])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(part):
                    y[:len(labels[i]), j] = labels[i]
                a, tape_a = self.ahead.forward(x, mask, True)
                b, tape_b = self.back.forward(x[::-1], mask[::-1], True)
                h = np.concatenate([a, b[::-1]], 2)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w + self.b[0], -30, 30)))
                dz = (p - y) * mask / mask.sum()
                dh = dz[:, :, None] * self.w
                grads = [*self.ahead.backward(x, tape_a, dh[:, :, :UNITS]), *self.back.backward(x[::-1], tape_b, dh[::-1, :, UNITS:]),
                         (h * dz[:, :, None]).sum((0, 1)), np.array([dz.sum()], np.float32)]
                step += 1
                for q, g, u, v in zip(params, grads, m1, m2, strict=True):
                    u += 0.1 * (g - u)
                    v += 0.001 * (g * g - v)
                    q -= rate * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


def labelled(blocks: list[Block]) -> np.ndarray:
    """Labels by the elements a block stands in.  On a page without an article
    element, long blocks with few links count as main text."""
    main = np.array([bool(MAIN.intersection(b.path)) for b in blocks], bool)
    other = np.array([bool(OTHER.intersection(b.path)) for b in blocks], bool)
    if not main.any():
        main = np.array([len(b.text) > 100 and b.linked < 0.3 for b in blocks], bool)
    return (main & ~other).astype(np.float32)


def rebuilt(blocks: list[Block], labels: np.ndarray, spare: list[str], rng) -> tuple[list[Block], np.ndarray]:
    """The page's main blocks under another template and in other elements, among
    blocks of others, which stand in the same kinds of element."""
    out, marks = [], []

    def unknown() -> tuple[str, ...]:
        """Now and then a class that tells nothing."""
        return ("." + "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 8))),) if rng.random() < 0.4 else ()

    frame = ("html", "body", *[("div", *unknown()), ()][rng.integers(2)], *MAIN_FRAMES[rng.integers(len(MAIN_FRAMES))], *unknown())

    def others(n: int):
        for _ in range(n):
            f = ("html", "body", *OTHER_FRAMES[rng.integers(len(OTHER_FRAMES))], *unknown())
            for _ in range(rng.integers(1, 5)):
                words = spare[rng.integers(len(spare))].split()
                cut = words[:rng.integers(1, 40)]
                leaf = ("p",) if rng.random() < 0.3 else LEAVES[rng.integers(len(LEAVES))]
                out.append(Block(" ".join(cut), f + leaf, float(rng.random() < 0.4)))
                marks.append(0.0)

    others(rng.integers(0, 4))
    main = [b for b, y in zip(blocks, labels, strict=True) if y]
    inside = set(rng.integers(0, max(1, len(main)), rng.integers(0, 3)).tolist()) if main else set()
    run = 0
    for i, b in enumerate(main):
        if not run:  # a few blocks of one kind follow each other, as in a list
            plain = rng.random() < 0.5
            run, leaf = rng.integers(1, 5), ("p",) if plain else LEAVES[rng.integers(len(LEAVES))]
        run -= 1
        own = b.path[-1:] if b.path and b.path[-1] in ("p", "h1") else ("p",)
        # headings, items and cells are often short
        text = b.text if plain or rng.random() < 0.4 else " ".join(b.text.split()[:rng.integers(1, 9)])
        out.append(Block(text, frame + (own if plain else leaf), b.linked))
        marks.append(1.0)
        if i in inside:  # something else inside the article's container
            f = OTHER_FRAMES[rng.integers(len(OTHER_FRAMES))]
            out.append(Block(" ".join(spare[rng.integers(len(spare))].split()[:rng.integers(1, 30)]), frame + f, float(rng.random() < 0.4)))
            marks.append(0.0)
    others(rng.integers(0, 5))
    return out, np.array(marks, np.float32)


def trained(pages: list[str], seed: int = 3) -> Labeller:
    """A labeller trained on these pages and on pages rebuilt from them."""
    rng = np.random.default_rng(seed)
    net = Labeller()
    seqs = [b for b in (list(leaf_blocks(p)) for p in pages if p) if b]
    marks = [labelled(b) for b in seqs]
    spare = [b.text for s in seqs for b in s] or ["text"]
    sampled = list(zip(seqs, marks, strict=True))
    for b, y in sampled:
        for _ in range(-(-REBUILT // len(sampled))):
            nb, ny = rebuilt(b, y, spare, rng)
            if nb:
                seqs.append(nb)
                marks.append(ny)
    if seqs:
        flat = features(seqs)
        ends = list(accumulate(map(len, seqs)))
        net.train([flat[e - len(s):e] for s, e in zip(seqs, ends, strict=True)], marks)
    return net


def main_texts(net: Labeller, pages: list[str]) -> list[str]:
    seqs = [list(leaf_blocks(p)) for p in pages]
    flat = features(seqs)
    ends = list(accumulate(map(len, seqs)))
    scores = net.scores([flat[e - len(s):e] for s, e in zip(seqs, ends, strict=True)])
    return [" ".join(b.text for b, p in zip(s, score, strict=True) if p > 0.5) for s, score in zip(seqs, scores, strict=True)]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, url, ``text`` (main blocks joined by one space) and
    ``n_chars`` (its code points).

    The labeller is trained on the driver on at most ``sample`` different pages,
    those whose html hashes lowest (equal pages count once); only hashes are
    compared to find them.  The weights, of a fixed size, are broadcast.
    Every whole page is then labelled in its own task, without a shuffle.

    Null and empty html, and pages without a block, give the empty text.  A null
    id or url stays null; repeated rows stay repeated; an empty table gives an
    empty result; other columns are not read.
    """
    pages = df.where(F.length(html_col) > 0).select(F.xxhash64(html_col).alias("k"), F.col(html_col).alias("h"))
    last = pages.select("k").distinct().orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    picked = [] if last is None else pages.where(F.col("k") <= last).dropDuplicates(["k"]).orderBy("k").collect()
    net = df.sparkSession.sparkContext.broadcast(trained([r["h"] for r in picked]))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                texts = main_texts(net.value, b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                                 [id_col, url_col, "text", "n_chars"])

    return df.select(id_col, url_col, F.coalesce(F.col(html_col), F.lit("")).alias("h")) \
        .mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
