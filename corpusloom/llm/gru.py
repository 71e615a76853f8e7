"""A bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as the sum of two inputs: its own embedding and the mean of the
embeddings of its character 4-grams (with marks at the word's ends), so that an
inflected form that was never seen still shares most of its input with its stem.
The network reads windows of words in both directions, an attention layer pools
the states of a window, and a text is as toxic as its worst window. In training,
a text is toxic if at least one of its windows is, so that all of them learn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpusloom.llm.hashing import join_texts, span_hashes, spans_of

WINDOW, STRIDE = 48, 32
HIDDEN, EMBED, ATTEND = 8, 8, 8
#: Words and 4-grams that get an embedding: those of the training sample, at most so many.
MAX_WORDS, MAX_GRAMS = 40_000, 60_000
#: Steps of training at least, however small the sample.
MIN_STEPS = 300
_CHUNK = 2048
_GRAM_BITS = 20
_MARK = np.uint8(1)

def normalise(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and U+00C0-U+00DE in lower case and a blank for all that is in no word."""
    b = data.copy()
    b[(b >= 65) & (b <= 90)] += 32
    lead = np.flatnonzero(b[:-1] == 0xC3)
    second = b[lead + 1]
    up = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1
    b[up] += 32
    word = (b >= 128) | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))
    b[~word] = 32
    return b


def words_of(data: np.ndarray, bounds: np.ndarray):
    """(bytes, starts, ends, words per text, hashes) of texts that lie in data at bounds.

    bounds must leave at least one byte that is in no word between two texts.
    """
    b = normalise(data)
    inside = b != 32
    starts, ends = spans_of(inside)
    counts = np.diff(np.searchsorted(starts, bounds))
    return b, starts, ends, counts, span_hashes(b, starts, ends)


def grams_of(b: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Character 4-grams of words as uint32, and how many each word has."""
    n = ends - starts + 2
    total = np.cumsum(n)
    first = total - n
    marked = np.full(int(total[-1]) if len(n) else 0, _MARK, np.uint8)
    place = np.arange(len(marked)) - np.repeat(first, n)
    inner = (place > 0) & (place < np.repeat(n - 1, n))
    src = np.repeat(starts - 1, n) + place
    marked[inner] = b[src[inner]]
    wide = np.concatenate([marked, np.zeros(3, np.uint8)]).astype(np.uint32)
    code = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    # A word of one letter has three bytes with its marks: it keeps one short gram.
    size = np.maximum(n - 3, 1)
    keep = place < np.repeat(size, n)
    short = np.repeat(n < 4, n) & keep
    code[short] &= np.uint32(0xFFFFFF00)
    return code[keep], size


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word within all words, words) of every window.

    Windows start every STRIDE words and overlap; the last one ends with the text.
    A text without words has one empty window.
    """
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    base = np.repeat(np.cumsum(counts) - counts, n)
    size = np.minimum(np.repeat(counts, n) - nth * STRIDE, WINDOW)
    return text, base + nth * STRIDE, size


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Vocabularies and weights; a few megabytes, whatever the corpus."""

    words: np.ndarray  # sorted hashes
    grams: np.ndarray  # sorted 4-grams
    w: dict[str, np.ndarray]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Direct look-up of 4-grams: code and row by slot."""
        code = np.zeros(1 << _GRAM_BITS, np.uint32)
        row = np.full(1 << _GRAM_BITS, -1, np.int32)
        slot = _slot(self.grams)
        code[slot] = self.grams
        row[slot] = np.arange(len(self.grams))
        return code, row

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Embedding row of each word hash; unknown words have the last row."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words)) if len(self.words) else np.zeros(len(h), np.int64)


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _GRAM_BITS)


def gram_rows(tables, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the known grams and how many each word has of them."""
    slot = _slot(code)
    row = np.where(tables[0][slot] == code, tables[1][slot], -1)
    known = row >= 0
    word = np.repeat(np.arange(len(size)), size)
    return row[known], np.bincount(word[known], minlength=len(size))


def _mean_rows(table: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(size), table.shape[1]), table.dtype)
    full = np.flatnonzero(size)
    if len(full):
        first = (np.cumsum(size) - size)[full]
        out[full] = np.add.reduceat(table[rows], first, axis=0) / size[full][:, None]
    return out


def _run(z, u, idx, size, reverse: bool, keep: bool):
    """States (steps, windows, hidden) of one direction; z: gate inputs of each word."""
    steps, n = idx.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    trace = []
    whole = bool((size == steps).all())
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        at = idx[t]
        r = _sigmoid(z[0][at] + h @ u[0])
        f = _sigmoid(z[1][at] + h @ u[1])
        g = h @ u[2]
        c = np.tanh(z[2][at] + r * g)
        new = h + f * (c - h)
        if not whole:
            live = (t < size)[:, None]
            new = np.where(live, new, h)
        if keep:
            trace.append((t, h, r, f, g, c))
        out[t] = h = new
    return out, trace


def forward(w, zf, zb, idx, size, keep=False):
    """Logits of windows; idx: (steps, windows) rows of z."""
    hf, tf = _run(zf, [w["uf_r"], w["uf_z"], w["uf_c"]], idx, size, False, keep)
    hb, tb = _run(zb, [w["ub_r"], w["ub_z"], w["ub_c"]], idx, size, True, keep)
    e1 = np.tanh(hf @ w["af"] + hb @ w["ab"] + w["a0"])
    score = e1 @ w["av"]
    score = np.where(np.arange(len(idx))[:, None] < np.maximum(size, 1), score, -1e9)
    score = np.exp(score - score.max(0))
    alpha = score / score.sum(0)
    cf = np.einsum("tn,tnh->nh", alpha, hf)
    cb = np.einsum("tn,tnh->nh", alpha, hb)
    logit = cf @ w["of"] + cb @ w["ob"] + w["o0"][0]
    return (logit, (hf, hb, tf, tb, e1, alpha, cf, cb)) if keep else logit


def gate_inputs(w, x):
    return [[x @ w[f"{d}_{g}"] + w[f"{d}_{g}0"] for g in "rzc"] for d in ("wf", "wb")]


def score_texts(model: Model, tables, texts: list[str]) -> np.ndarray:
    """Score of each whole text, 0 to 1, over all its overlapping windows."""
    data, bounds = join_texts(texts)
    b, starts, ends, counts, h = words_of(data, bounds)
    # Words that occur more than once in the batch are embedded once.
    distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
    w = model.w
    rows, size = gram_rows(tables, *grams_of(b, starts[first], ends[first]))
    x = w["ew"][model.rows(distinct)] + _mean_rows(w["ec"], rows, size)
    x = np.concatenate([x, np.zeros((1, EMBED), np.float32)])
    zf, zb = gate_inputs(w, x)
    text, at, length = windows_of(counts)
    number = np.append(number, len(distinct)).astype(np.int64)
    # Windows of one length stand together, so that most chunks need no mask.
    order = np.argsort(-length, kind="stable")
    best = np.full(len(texts), -np.inf)
    for i in range(0, len(order), _CHUNK):
        o = order[i : i + _CHUNK]
        steps = max(1, int(length[o[0]]))
        place = at[o][None, :] + np.arange(steps)[:, None]
        idx = np.where(np.arange(steps)[:, None] < length[o], number[np.minimum(place, len(number) - 1)], len(distinct))
        np.maximum.at(best, text[o], forward(w, zf, zb, idx, length[o]).astype(np.float64))
    return 1 / (1 + np.exp(-best))


def _init(rng, words: int, grams: int) -> dict[str, np.ndarray]:
    def mat(a, b):
        return (rng.standard_normal((a, b)) * (0.7 / np.sqrt(a))).astype(np.float32)

    w = {"ew": (rng.standard_normal((words + 1, EMBED)) * 0.02).astype(np.float32)}
    w["ew"][-1] = 0
    w["ec"] = (rng.standard_normal((max(grams, 1), EMBED)) * 0.02).astype(np.float32)
    for d in "fb":
        for g in "rzc":
            w[f"w{d}_{g}"], w[f"u{d}_{g}"] = mat(EMBED, HIDDEN), mat(HIDDEN, HIDDEN)
            w[f"w{d}_{g}0"] = np.zeros(HIDDEN, np.float32)
        w[f"a{d}"], w[f"o{d}"] = mat(HIDDEN, ATTEND), mat(HIDDEN, 1)[:, 0]
    w["a0"], w["av"] = np.zeros(ATTEND, np.float32), mat(ATTEND, 1)[:, 0]
    w["o0"] = np.array([-3.0], np.float32)
    return w


def _back(zgrad, du, u, idx, trace, dout, size):
    """Back-propagation through time of one direction; adds to zgrad and du."""
    dh = np.zeros_like(dout[0])
    for t, h, r, f, g, c in reversed(trace):
        live = (t < size)[:, None]
        dh = dh + dout[t]
        d = np.where(live, dh, 0)
        df = d * (c - h) * f * (1 - f)
        dc = d * f * (1 - c * c)
        dg = dc * r
        dr = dc * g * r * (1 - r)
        for k, x in ((0, dr), (1, df), (2, dc)):
            np.add.at(zgrad[k], idx[t], x)
        for k, x in ((0, dr), (1, df), (2, dg)):
            du[k] += h.T @ x
        dh = np.where(live, d * (1 - f) + dr @ u[0].T + df @ u[1].T + dg @ u[2].T, dh)


def _gradients(w, x, idx, size, owner, label, weight):
    """Loss of a batch of texts and the gradients of all weights but the embeddings, and of x."""
    zf, zb = gate_inputs(w, x)
    logit, (hf, hb, tf, tb, e1, alpha, cf, cb) = forward(w, zf, zb, idx, size, keep=True)
    logit = logit.astype(np.float64)
    p = 1 / (1 + np.exp(-logit))
    log_no = np.zeros(len(label))
    np.add.at(log_no, owner, -np.logaddexp(0, logit))
    yes = np.clip(-np.expm1(log_no), 1e-9, 1)
    loss = -(weight * np.where(label == 1, np.log(yes), log_no)).sum()
    # d loss / d logit: p for a clean text; -p * (1 - yes) / yes for a toxic one
    pull = np.where(label == 1, -np.exp(log_no) / yes, 1.0) * weight
    d = (p * pull[owner]).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("ew", "ec")}
    g["of"], g["ob"], g["o0"] = cf.T @ d, cb.T @ d, np.array([d.sum()], np.float32)
    dcf, dcb = d[:, None] * w["of"], d[:, None] * w["ob"]
    dalpha = np.einsum("tnh,nh->tn", hf, dcf) + np.einsum("tnh,nh->tn", hb, dcb)
    dscore = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["av"] = np.einsum("tn,tna->a", dscore, e1)
    de = dscore[:, :, None] * w["av"] * (1 - e1 * e1)
    g["a0"] = de.sum((0, 1))
    g["af"], g["ab"] = np.einsum("tnh,tna->ha", hf, de), np.einsum("tnh,tna->ha", hb, de)
    dx = np.zeros_like(x)
    for name, h_all, trace, dc, av in (("f", hf, tf, dcf, w["af"]), ("b", hb, tb, dcb, w["ab"])):
        dout = alpha[:, :, None] * dc[None] + de @ av.T
        zg = [np.zeros((len(x), HIDDEN), np.float32) for _ in range(3)]
        du = [g[f"u{name}_{k}"] for k in "rzc"]
        _back(zg, du, [w[f"u{name}_{k}"] for k in "rzc"], idx, trace, dout, size)
        for k, z in zip("rzc", zg, strict=True):
            g[f"w{name}_{k}"], g[f"w{name}_{k}0"] = x.T @ z, z.sum(0)
            dx += z @ w[f"w{name}_{k}"].T
    return loss, g, dx


def _odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Shrunk log-odds of texts that hold a feature, toxic against clean."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return np.clip(odds * (pos + neg) / (pos + neg + 6), -2, 2)


def train(texts: list[str], labels: np.ndarray, epochs: int = 5, seed: int = 13, batch: int = 48) -> Model:
    """Fit a model to labelled texts by Adam on the texts' cross-entropy.

    The first dimension of each embedding starts from the feature's log-odds in
    the sample, the rest at random. Without both labels the model is untrained
    and scores every text close to the share of toxic ones.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    data, bounds = join_texts(texts)
    b, starts, ends, counts, h = words_of(data, bounds)
    doc = np.repeat(np.arange(len(texts)), counts)
    distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
    code, size = grams_of(b, starts[first], ends[first])
    n_pos, n_neg = int((labels == 1).sum()), int((labels == 0).sum())

    def by_label(feature, owner, kinds):
        pair = np.unique(feature.astype(np.int64) * len(texts) + owner)
        f, y = pair // max(len(texts), 1), labels[pair % max(len(texts), 1)]
        return np.bincount(f[y == 1], minlength=kinds), np.bincount(f[y == 0], minlength=kinds)

    wpos, wneg = by_label(number, doc, len(distinct))
    keep = np.flatnonzero(wpos + wneg >= 3)
    keep = np.sort(keep[np.argsort(-(wpos + wneg)[keep], kind="stable")[:MAX_WORDS]])
    gram, gnum = np.unique(code, return_inverse=True)
    # A text's grams: those of its distinct words. Some texts at a time, to bound memory.
    span = np.cumsum(size) - size
    gpos, gneg = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    for d in range(0, len(texts), 100):
        here = slice(*np.searchsorted(doc, [d, d + 100]))
        pair = np.unique(number[here].astype(np.int64) * len(texts) + doc[here])
        pw, pd = pair // len(texts), pair % len(texts)
        rep = size[pw]
        inner = np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep)
        more = by_label(gnum[np.repeat(span[pw], rep) + inner], np.repeat(pd, rep), len(gram))
        gpos += more[0]
        gneg += more[1]
    gkeep = np.flatnonzero(gpos + gneg >= 3)
    gkeep = np.sort(gkeep[np.argsort(-(gpos + gneg)[gkeep], kind="stable")[:MAX_GRAMS]])

    w = _init(rng, len(keep), len(gkeep))
    w["ew"][: len(keep), 0] += _odds(wpos, wneg, n_pos, n_neg)[keep]
    if len(gkeep):
        w["ec"][:, 0] += _odds(gpos, gneg, n_pos, n_neg)[gkeep]
    model = Model(distinct[keep], gram[gkeep], w)
    if not (n_pos and n_neg):
        return model
    tables = model.tables()
    word_row = model.rows(distinct)
    grow, gsize = gram_rows(tables, code, size)
    gfirst = np.cumsum(gsize) - gsize
    text, at, length = windows_of(counts)
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    weight = np.ones(len(labels))
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    batches = -(-len(texts) // batch)
    epochs = max(epochs, -(-MIN_STEPS // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), batches):
            step += 1
            pick, owner = [], []
            for j, d in enumerate(part):
                own = np.arange(begin[d], begin[d + 1])
                pick.append(own)
                owner.append(np.full(len(own), j))
            pick, owner = np.concatenate(pick), np.concatenate(owner)
            wide = max(1, int(length[pick].max()))
            t = np.arange(wide)[:, None]
            place = np.minimum(at[pick][None, :] + t, max(len(number) - 1, 0))
            live = t < length[pick]
            used, idx = np.unique(number[place[live]], return_inverse=True)
            grid = np.full(live.shape, len(used))
            grid[live] = idx
            # Inputs of the batch's words, and what of them is dropped in this step.
            sizes = gsize[used]
            inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = grow[np.repeat(gfirst[used], sizes) + inner]
            on_word = (rng.random(len(used)) > 0.3).astype(np.float32)[:, None]
            x = w["ew"][word_row[used]] * on_word + _mean_rows(w["ec"], rows, sizes)
            x = np.concatenate([x, np.zeros((1, EMBED), np.float32)])
            _, g, dx = _gradients(w, x, grid, length[pick], owner, labels[part], weight[part] / len(part))
            dx = dx[:-1]
            g["ew"] = np.zeros_like(w["ew"])
            np.add.at(g["ew"], word_row[used], dx * on_word)
            g["ew"][-1] = 0
            g["ec"] = np.zeros_like(w["ec"])
            np.add.at(g["ec"], rows, np.repeat(dx / np.maximum(sizes, 1)[:, None], sizes, axis=0))
            rate = 0.01 * (1 - step / (steps + 1)) + 0.001
            for k in w:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.01 * (g[k] * g[k] - m2[k])
                w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    model.w = {k: v.astype(np.float32) for k, v in w.items()}
    return model
