"""HTML extraction: a recurrent network labels every block of a page as article or not.

A page is the sequence of its blocks. Each is a vector of its path of tags, its hashed words and a
few sizes; a bidirectional LSTM runs over the whole sequence, so a block is judged with all that
stands before and after it. The network is trained here, by numpy, on made-up layouts and on a
bounded sample of pages whose own markup names the article.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake.llm.common import arrow_map, prepare
from caretlake.llm.html_blocks import (
    PATH_BUCKETS,
    WORD_BUCKETS,
    Block,
    blocks_of,
    word_buckets,
)
from caretlake.llm.page_samples import made_up, told_by_markup

PATH, WORD, SIZES, HIDDEN = 16, 8, 6, 16
INPUT = PATH + WORD + SIZES

# Pages the network learns from: those of the table with the smallest hashes among those that
# name their article and have no more than SAMPLE_CHARS characters, and made-up ones.
SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES, EPOCHS = 300, 50_000, 600, 14
# Cells (blocks and padding) of pages the network looks at together.
CELLS = 40_000


@dataclass
class Features:
    """Blocks of some pages as arrays; buckets lie end to end."""

    path: np.ndarray
    path_row: np.ndarray
    word: np.ndarray
    word_row: np.ndarray
    sizes: np.ndarray

    def paths_only(self) -> Features:
        none = np.zeros(0, np.int64)
        return Features(self.path, self.path_row, none, none, np.zeros_like(self.sizes))


def features_of(blocks: list[Block]) -> Features:
    paths = [sorted(b.path) for b in blocks]
    words = [word_buckets(b.text) for b in blocks]
    path_n = np.array([len(p) for p in paths], dtype=np.int64)
    word_n = np.array([len(w) for w in words], dtype=np.int64)
    chars = np.array([len(b.text) for b in blocks], dtype=np.float32)
    ends = np.array([b.text[-1] in ".!?…。" for b in blocks], dtype=np.float32)
    stops = np.array([b.text.count(".") + b.text.count(",") for b in blocks], dtype=np.float32)
    linked = np.array([b.linked for b in blocks], dtype=np.float32)
    sizes = np.stack([np.log1p(chars) / 5, np.minimum(1, linked / np.maximum(chars, 1)),
                      np.log1p(word_n).astype(np.float32) / 4, ends,
                      stops / np.maximum(word_n, 1), np.ones(len(blocks), np.float32)], axis=1) \
        if blocks else np.zeros((0, SIZES), np.float32)
    rows = np.arange(len(blocks))
    return Features(np.fromiter((i for p in paths for i in p), np.int64, int(path_n.sum())),
                    np.repeat(rows, path_n),
                    np.fromiter((i for w in words for i in w), np.int64, int(word_n.sum())),
                    np.repeat(rows, word_n), sizes.astype(np.float32))


def _rows_sum(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row; rows ascend."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


class Labeller:
    """The network's weights and its two passes."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def start(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH)).astype(np.float32),
                  "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD)).astype(np.float32),
                  "out": start(2 * HIDDEN + INPUT, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w["x" + side] = start(INPUT, 4 * HIDDEN)
            self.w["h" + side] = start(HIDDEN, 4 * HIDDEN)
            self.w["b" + side] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)

    def inputs(self, f: Features) -> np.ndarray:
        n = len(f.sizes)
        path = _rows_sum(self.w["path"][f.path], f.path_row, n)
        counts = np.maximum(np.bincount(f.word_row, minlength=n), 1).astype(np.float32)
        words = _rows_sum(self.w["word"][f.word], f.word_row, n) / counts[:, None]
        return np.concatenate([path, words, f.sizes], axis=1)

    def _side(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States over time (time, page, HIDDEN); backwards for side b. Padding leaves a state as it is."""
        steps, pages, _ = x.shape
        z_all = x @ self.w["x" + side] + self.w["b" + side]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out, memory = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = z_all[t] + h @ self.w["h" + side]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, forget, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            c_new = forget * c + i * g
            th = np.tanh(c_new)
            h_new = o * th
            m = mask[t][:, None]
            if keep:
                memory.append((t, i, forget, o, g, c, th, h, m))
            c, h = np.where(m, c_new, c), np.where(m, h_new, h)
            out[t] = h
        return out, memory

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, m1 = self._side("f", x, mask, keep)
        backward, m2 = self._side("b", x, mask, keep)
        top = np.concatenate([forward, backward, x], axis=2)
        return (top @ self.w["out"])[..., 0] + self.w["bias"], top, (m1, m2)

    def is_article(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks belong to the article. Pages of like length together."""
        sizes = np.array([len(p) for p in pages])
        order, out, at = np.argsort(sizes, kind="stable"), [np.zeros(0, bool)] * len(pages), 0
        while at < len(order):
            some = [order[at]]
            while at + len(some) < len(order) and \
                    sizes[order[at + len(some)]] * (len(some) + 1) <= CELLS:
                some.append(order[at + len(some)])
            at += len(some)
            x, mask = self._padded([features_of(pages[k]) for k in some])
            got = self.logits(x, mask)[0] > 0
            for column, k in enumerate(some):
                out[k] = got[:sizes[k], column]
        return out

    def _padded(self, some: list[Features]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(f.sizes) for f in some)
        x = np.zeros((steps, len(some), INPUT), np.float32)
        mask = np.zeros((steps, len(some)), bool)
        for column, f in enumerate(some):
            x[:len(f.sizes), column] = self.inputs(f)
            mask[:len(f.sizes), column] = True
        return x, mask

    def gradients(self, some: list[Features], labels: list[np.ndarray]) -> tuple[float, dict]:
        """Loss and gradients of all weights, back through time on both sides."""
        x, mask = self._padded(some)
        y = np.zeros(mask.shape, np.float32)
        for column, own in enumerate(labels):
            y[:len(own), column] = own
        logits, top, memories = self.logits(x, mask, keep=True)
        p = _sigmoid(logits)
        n = max(1, int(mask.sum()))
        loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum()) / n
        d = ((p - y) * mask / n)[..., None].astype(np.float32)
        grad = {"out": np.einsum("tpi,tpj->ij", top, d), "bias": d.sum(axis=(0, 1))}
        d_top = d * self.w["out"][:, 0]
        d_x = d_top[..., 2 * HIDDEN:].copy()
        for side, memory, d_out in (("f", memories[0], d_top[..., :HIDDEN]),
                                    ("b", memories[1], d_top[..., HIDDEN:2 * HIDDEN])):
            d_z = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            h_in = np.zeros((*mask.shape, HIDDEN), np.float32)
            d_h = d_c = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, i, forget, o, g, c, th, h, m in reversed(memory):
                d_h = d_h + d_out[t]
                in_h = np.where(m, d_h, 0)
                in_c = np.where(m, d_c, 0) + in_h * o * (1 - th * th)
                z = np.concatenate([in_c * g * i * (1 - i), in_c * c * forget * (1 - forget),
                                    in_h * th * o * (1 - o), in_c * i * (1 - g * g)], axis=1)
                d_z[t], h_in[t] = z, h
                d_h = np.where(m, 0, d_h) + z @ self.w["h" + side].T
                d_c = np.where(m, 0, d_c) + in_c * forget
            grad["x" + side] = np.einsum("tpi,tpj->ij", x, d_z)
            grad["h" + side] = np.einsum("tpi,tpj->ij", h_in, d_z)
            grad["b" + side] = d_z.sum(axis=(0, 1))
            d_x += d_z @ self.w["x" + side].T
        grad["path"], grad["word"] = (np.zeros_like(self.w[k]) for k in ("path", "word"))
        for column, f in enumerate(some):
            own = d_x[:len(f.sizes), column]
            np.add.at(grad["path"], f.path, own[f.path_row, :PATH])
            counts = np.maximum(np.bincount(f.word_row, minlength=len(f.sizes)), 1)
            np.add.at(grad["word"], f.word,
                      (own[:, PATH:PATH + WORD] / counts[:, None])[f.word_row])
        return loss, grad

    def train(self, pages: list[tuple[list[Block], list[bool]]], epochs: int = EPOCHS,
              rate: float = 0.015, together: int = 16, seed: int = 5) -> float:
        """Adam over shuffled batches. Every other page is shown without words and sizes, so paths are
        learned to the full where they tell."""
        rng = np.random.default_rng(seed)
        pages = [(features_of(b), np.array(y, np.float32)) for b, y in pages if b]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(pages)), []
            for at in range(0, len(order), together):
                some = [pages[k] for k in order[at:at + together]]
                loss, grad = self.gradients(
                    [f.paths_only() if rng.random() < 1 / 2 else f for f, _ in some],
                    [y for _, y in some])
                losses.append(loss)
                step += 1
                slow = rate * (1 - 0.9 * epoch / epochs)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= slow * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                   sample_pages: int = SAMPLE_PAGES, made_pages: int = MADE_PAGES,
                   epochs: int = EPOCHS) -> Labeller:
    """Learn from `made_pages` made-up pages and at most `sample_pages` of the table.

    The driver gets the sampled pages, at most SAMPLE_CHARS characters each. Pages that don't name
    their article teach nothing; a table without any leaves the made-up ones.
    """
    html = F.col(f"`{html_col}`")
    named = pages.select(F.xxhash64(F.col(f"`{id_col}`").cast("string"), html).alias("key"),
                         html.alias("html")).filter(
        (F.length(html) <= SAMPLE_CHARS) & html.rlike("(?i)<(article|main)[\\s>]"))
    # Numbers are ranked first, so tasks hand on eight bytes a page; repeated pages count once.
    keys = [r.key for r in named.groupBy("key").count().orderBy("key").limit(sample_pages).collect()]
    rows = named.filter(F.col("key").isin(keys)).groupBy("key").agg(F.min("html").alias("html"))
    told = [told_by_markup(r.html) for r in sorted(rows.collect(), key=lambda r: r.key)]
    labeller = Labeller()
    labeller.train([p for p in told if any(p[1])] + made_up(made_pages), epochs=epochs)
    return labeller


def extract_text(pages: DataFrame, model: Labeller, html_col: str = "html",
                 keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of `keep`, then text and n_chars: the article's blocks, joined by spaces.

    Null and empty pages, and pages without blocks, have an empty text. Repeated rows and ids each
    give a row. Pages of any length are read whole; other columns are not read.
    """
    prepare(pages.sparkSession)
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    columns = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [blocks_of(h) for h in batch["html"]]
            texts = [" ".join(b.text for b, own in zip(blocks, which.tolist()) if own)
                     for blocks, which in zip(found, model.is_article(found))]
            yield {**{c: batch[f"kept_{i}"] for i, c in enumerate(keep)},
                   "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select(*columns, html.alias("html")), run,
                     f"{fields}, text string, n_chars bigint",
                     raw=tuple(f"kept_{i}" for i in range(len(keep))))
