"""Slow versions by definition."""

import collections
import hashlib
import html.parser
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_groups(rows):
    """Smallest id of each row's component; rows are (id, text) with ids of their own."""
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    by = collections.defaultdict(list)
    for k, s in enumerate(sets):
        both = collections.Counter(j for h in s for j in by[h])
        for j, x in both.items():
            if 100 * x >= 75 * (len(s) + len(sets[j]) - x):
                a, b = root(j), root(k)
                at[max(a, b)] = min(a, b)
        for h in s:
            by[h].append(k)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    return [min((i for i in ids[root(k)] if i is not None), default=None) for k in range(len(rows))], [len(s) for s in sets]


def alike(words, item, percent=75):
    """Similarity of every window of the item's length that reaches the threshold, by start."""
    size, out = min(len(item), 5), {}
    runs = lambda w: collections.Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    b = runs(item)
    for s in range(max(0, len(words) - len(item)) + 1):
        a = runs(words[s : s + len(item)])
        if 100 * (a & b).total() >= percent * (a | b).total():
            out[s] = (a & b).total() / (a | b).total()
    return out


def weighted(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return (a & b).total() / (a | b).total()


def removed_marks(rows, length=200):
    """A byte for each byte of (id, text): 1 where a string of that length that starts elsewhere too covers it."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out.append((i, gone))
    return dict(out) if len(dict(out)) == len(out) else out


def left_of(text, gone):
    """The text without the characters of which every byte is marked."""
    at, out = 0, []
    for c in text or "":
        n = len(c.encode())
        if not all(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def removed(rows, length=200):
    marks = removed_marks([(k, t) for k, (_, t) in enumerate(rows)], length)
    out = []
    for k, (i, t) in enumerate(rows):
        b, gone = (t or "").encode(), marks[k]
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def quality_features(text, stop_words):
    """The features of a text, one by one."""
    raw, w = text.encode(), [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text)]
    count = lambda chars: sum(raw.count(ord(c)) for c in chars)
    n, size = max(len(w), 1), max(len(raw), 1)
    upper, lower = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 for b in raw)
    symbols, shouts = count("#*$%&|<>@^~_={}[]\\"), count("!?")
    spaces, stops, lines, digits = count(" \t\x0b\x0c\r"), count(".,;:"), count("\n"), sum(48 <= b < 58 for b in raw)
    other = len(raw) - upper - lower - symbols - shouts - spaces - stops - lines - digits
    stop = sum(x in stop_words for x in w) / n
    distinct, top = len(set(w)) / n, max(collections.Counter(w).values(), default=0) / n
    again = sum(a == b for a, b in zip(w, w[1:]))  # noqa: B905
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)] * bool(w)
    fresh = len(set(runs)) / len(runs) if runs else 0.0
    log, length, letters = math.log1p(len(w)), (size - spaces - lines) / n, max(upper + lower, 1)
    return [
        float(len(w) > 0), log, min(log, 4.0), stop, max(0.0, 0.1 - stop), symbols / n, min(symbols / n, 0.1), upper / letters, min(upper / letters, 0.3),
        digits / size, shouts / n, min(shouts / n, 0.1), stops / n, lines / n, distinct, max(0.0, 0.3 - distinct), top, max(0.0, top - 0.2), fresh, max(0.0, 0.7 - fresh),
        length, max(0.0, length - 7.0), max(0.0, 4.0 - length), other / size, again / n, min(again / n, 0.2),
    ]


def pairwise_fit(x, y, share_good, pairs, steps, l2=1e-3):
    """Weights and cut, pair by pair and quantile by quantile, for the pairs that a seed of 7 draws."""
    import numpy as np

    rows, width = len(x), len(x[0])
    mean = [sum(r[k] for r in x) / rows for k in range(width)]
    scale = [math.sqrt(sum((r[k] - mean[k]) ** 2 for r in x) / rows) + 1e-6 for k in range(width)]
    z = [[min(max((r[k] - mean[k]) / scale[k], -8), 8) for k in range(width)] for r in x]
    draw, good, bad = np.random.default_rng(7), [i for i in range(rows) if y[i] == 1], [i for i in range(rows) if y[i] == 0]
    d = [[z[a][k] - z[b][k] for k in range(width)] for a, b in zip(draw.choice(good, pairs).tolist(), draw.choice(bad, pairs).tolist(), strict=True)]
    w, v = [0.0] * width, [0.0] * width
    for _ in range(steps):
        p = [1 / (1 + math.exp(sum(a * b for a, b in zip(r, w, strict=True)))) for r in d]
        v = [0.9 * v[k] - 0.1 * (l2 * w[k] - sum(r[k] * q for r, q in zip(d, p, strict=True)) / pairs) for k in range(width)]
        w = [a + b for a, b in zip(w, v, strict=True)]
    raw = sorted((sum(a * b for a, b in zip(r, w, strict=True)), label) for r, label in zip(z, y, strict=True))
    right, shares = share_good, []
    for _, label in raw:
        right += (1 - share_good) / len(bad) if label == 0 else -share_good / len(good)
        shares.append(right)
    best = [k for k in range(rows) if shares[k] >= max(shares) - 1e-12]
    k = best[len(best) // 2]
    return w, (raw[k][0] + raw[min(k + 1, rows - 1)][0]) / 2


class _Tree(html.parser.HTMLParser):
    """Elements as [name, parent, children, mark, names down to here]; pages are well formed, marks are classes."""

    def __init__(self, source, strong, weak):
        super().__init__()
        self.root = self.at = ["", None, [], 0, ()]
        self.marks = (strong, weak)
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        name = dict(attrs).get("class", "")
        mark = 2 if name in self.marks[0] else 1 if name in self.marks[1] else 0
        e = [tag, self.at, [], mark, (*self.at[4], tag, name)]
        self.at[2].append(e)
        self.at = e

    def handle_endtag(self, tag):
        self.at = self.at[1]

    def handle_data(self, data):
        if data.strip():
            self.at[2].append(data.strip())


def _texts(e, hidden=False):
    return [e] if isinstance(e, str) else [] if e[3] == 2 and not hidden else [t for c in e[2] for t in _texts(c, hidden)]


def _own_text(e):
    """The text of an article or main outside of those inside it."""
    return sum(len(c) if isinstance(c, str) else 0 if c[0] in ("article", "main") or c[3] == 2 else _own_text(c) for c in e[2])


def _all(e):
    """An element and those in it, but none in one that marks itself."""
    yield e
    for c in e[2]:
        if not isinstance(c, str) and e[3] < 2:
            yield from _all(c)


def main_texts(pages, share, least, stock=(3, 0.15, 0.5), marked=2, strong=(), weak=()):
    """Text by page_id of (page_id, host, html) rows without the templates of its host."""
    own = ("article", "main")
    under, leads, fills = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(lambda: collections.defaultdict(set))
    trees, inside, of = {}, collections.defaultdict(bool), {}
    for i, host, source in pages:
        root = _Tree(source, strong, weak).root
        trees[i] = (host, root)
        owns = [e for e in _all(root) if e[0] in own and _texts(e)]
        closed = [e for e in _after(root) if any(e is x for x in owns)]
        best = max((_own_text(e) for e in closed), default=0)
        lead = next(((e[0], tuple(_texts(e))) for e in closed if best and _own_text(e) == best), None)
        page = lead or ("page", tuple(_texts(root)))
        leads[host].add(page)
        for e in _all(root):
            judged = e[3] == 2 or e[0] not in ("", *own) and _texts(e) and not any(x[0] in own and _texts(x) for x in _all(e))
            if not judged:
                continue
            up = e[1]
            while up is not None and up[0] not in own:
                up = up[1]
            once = (up[0], tuple(_texts(up))) if up is not None and _texts(up) else page
            what, slot = (e[0], e[3], tuple(_texts(e, True))), (host, e[4], e[3])
            of[id(e)] = (host, what), slot
            under[host, what].add(once)
            fills[slot][what].add(once)
            inside[slot] |= up is not None or lead is None
    gone = {x for x, n in under.items() if len(n) >= least and len(n) >= share * len(leads[x[0]])}
    for slot, each in fills.items():
        again = sum(len(under[slot[0], w]) >= 2 for w in each)
        if again >= stock[0] and again >= stock[1 + inside[slot]] * len(each) or slot[2] and sum(map(len, each.values())) >= marked and (not inside[slot] or again):
            gone.add(slot)

    def kept(e):
        if isinstance(e, str):
            return [e]
        return [] if e[3] == 2 or gone & {*of.get(id(e), ())} else [t for c in e[2] for t in kept(c)]

    return {i: "\n\n".join(kept(root)) for i, (_, root) in trees.items()}


def _after(e):
    """Elements in the order in which they close."""
    for c in e[2]:
        if not isinstance(c, str):
            yield from _after(c)
    yield e


def key(row):
    return str(tuple(row))
