"""Plain, slow versions of the contracts, over Python lists; the operators are held against them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text: str, shingle: int = 4) -> int:
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for j in range(64):
            bits[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * bits[j] > len(grams))


def components(fps: dict[int, int], radius: int = 4) -> dict[int, int]:
    ids = sorted(fps)
    low = {i: i for i in ids}

    def find(x: int) -> int:
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: find(i) for i in ids}


def luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(d[::-1]):
        n = int(c)
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        t += n
    return t % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    }


def base_written(text: str) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, s in base_spans(text).items() for a, b in s)


def statistics(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    many = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def chat(rows: list[tuple[int, str, str]]) -> tuple[int, str, int, str]:
    """Turns, their digest, loss characters and digest of one conversation's (turn, role, text)."""
    rows = sorted(rows)
    loss = "".join(t for _, r, t in rows if r == "assistant")
    return len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss)


class Katz:
    """A plain Katz backoff model of order three over dictionaries; ``train`` are texts."""

    def __init__(self, train):
        import collections

        self.counts = [collections.Counter() for _ in range(3)]
        for t in train:
            words = ["<", "<", *t.encode().decode().lower().split(), ">"]
            for i in range(2, len(words)):
                for n in range(3):
                    self.counts[n][(*words[i - n : i], words[i])] += 1
        self.d = [self.discounts(list(c.values())) for c in self.counts]
        self.n = sum(self.counts[0].values())
        given = sum(self.kept(0, c) for c in self.counts[0].values())
        if self.n and given >= self.n * (1 - 1e-12):
            self.d[0] = [x * (1 - 0.5 / self.n) for x in self.d[0]]
        self.known = {w: self.kept(0, c) / self.n for (w,), c in self.counts[0].items()}
        self.unknown = 1 - sum(self.known.values())
        self.after = {}
        for n in (1, 2):
            for gram, c in self.counts[n].items():
                self.after.setdefault(gram[:-1], {})[gram[-1]] = c
        self.alphas = {}

    @staticmethod
    def discounts(counts, k=5):
        n = {r: counts.count(r) for r in range(1, k + 2)}
        d = [0.0, 0.5, *[1.0] * k]
        if n[1]:
            a = (k + 1) * n[k + 1] / n[1]
            for r in range(1, k + 1):
                if n[r] and a < 1:
                    x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
                    if 0 < x < 1:
                        d[r] = x
        return d

    def kept(self, n, count):
        return self.d[n][min(count, len(self.d[n]) - 1)] * count

    def p(self, history, word):
        if not history:
            return self.known.get(word, self.unknown)
        seen = self.after.get(history)
        if not seen:
            return self.p(history[1:], word)
        count, mass = sum(seen.values()), sum(self.kept(len(history), c) for c in seen.values())
        total = count if mass < count * (1 - 1e-12) else count + 1
        if word in seen:
            return self.kept(len(history), seen[word]) / total
        return self.alpha(history) * self.p(history[1:], word)

    def alpha(self, history):
        if history not in self.alphas:
            seen = self.after[history]
            count, mass = sum(seen.values()), sum(self.kept(len(history), c) for c in seen.values())
            total = count if mass < count * (1 - 1e-12) else count + 1
            self.alphas[history] = (1 - mass / total) / (1 - sum(self.p(history[1:], w) for w in seen))
        return self.alphas[history]

    def score(self, text):
        import math

        words = ["<", "<", *text.lower().split(), ">"]
        return sum(math.log10(self.p((words[i - 2], words[i - 1]), words[i])) for i in range(2, len(words)))


class Toxicity:
    """Plain class-conditional word models with a shared lower order; ``rows`` are texts with labels 0 or 1."""

    PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„‘’«»¡¿"

    def __init__(self, rows, chance):
        self.chance = chance
        self.counts = [{}, {}]
        for text, label in rows:
            for w in set(self.words(text)):
                self.counts[label][w] = self.counts[label].get(w, 0) + 1
        self.totals = [sum(c.values()) for c in self.counts]
        self.met = {w: self.counts[0].get(w, 0) + self.counts[1].get(w, 0) for w in {*self.counts[0], *self.counts[1]}}
        self.left = [1 - sum(self.above(w, c) for w in self.met) for c in (0, 1)]

    def words(self, text):
        return [w for w in (x.strip(self.PUNCTUATION) for x in text.lower().split()) if w]

    def shared(self, word):
        return (self.met.get(word, 0) + 0.5) / (sum(self.totals) + 0.5 * (len(self.met) + 1))

    def above(self, word, label, less=0):
        return max((self.counts[label].get(word, 0) - less) / self.totals[label] - (self.shared(word) ** 0.5 + self.chance**0.5) ** 2, 0)

    def p(self, word, label, less=0):
        return self.above(word, label, less) + self.left[label] * self.shared(word)

    def compare(self, text, own=None):
        import math

        words = set(self.words(text))
        return sum(math.log(self.p(w, 1, own == 1)) - math.log(self.p(w, 0, own == 0)) for w in words) / max(1, len(words))


class ToxicityInOrder(Toxicity):
    """The same with every word after its history, over continuation counts of both classes."""

    def __init__(self, rows, chance):
        super().__init__(rows, chance)
        self.pairs = [{}, {}]
        for text, label in rows:
            for x in set(self.steps(text)):
                self.pairs[label][x] = self.pairs[label].get(x, 0) + 1
        self.all = [sum(c.values()) for c in self.pairs]
        self.both = {x: self.pairs[0].get(x, 0) + self.pairs[1].get(x, 0) for x in {*self.pairs[0], *self.pairs[1]}}
        self.heads = {h for h, _ in self.both}

    def steps(self, text):
        words = ["<", *self.words(text)]
        return list(zip(words, words[1:]))

    def below(self, word):
        return (sum(w == word for _, w in self.both) + 0.5) / (len(self.both) + 0.5 * (len(self.met) + 1))

    def p(self, word, label, less=0):
        return self.above(word, label, less) + self.left[label] * self.below(word)

    def kept(self, pair, label, less=0):
        d = ((self.both[pair] / sum(self.all)) ** 0.5 + self.chance**0.5) ** 2 * self.all[label]
        return max(self.pairs[label].get(pair, 0) - less - d, 0)

    def after(self, history, word, label, less=0):
        total = max(1, sum(n for (h, _), n in self.pairs[label].items() if h == history))
        left = 1 - sum(self.kept(x, label) for x in self.both if x[0] == history) / total
        own = self.kept((history, word), label, less) / total if (history, word) in self.both else 0
        return own + left * self.p(word, label, less)

    def compare(self, text, own=None):
        import math

        steps = self.steps(text)
        return sum(math.log(self.after(*x, 1, own == 1)) - math.log(self.after(*x, 0, own == 0)) for x in steps) / max(1, len(steps))


def visible(page):
    """Text of a page whose markup is closed, by one pattern."""
    import html
    import re

    return html.unescape(re.sub(r"(?si)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", page))


def fused(rows, langs, table, trigrams, weight=0.25, strength=20.0, sure=0.9):
    """Language, posterior and acceptance of each row (id, text, declared, address) by plain counts."""
    import collections
    import math
    import re

    made = []
    for i, text, said, url in rows:
        codes = trigrams(text or "")
        host = (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", url or "") or [None, ""])[1].lower()
        segment = (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", url or "") or [None, ""])[1].lower()
        suffix = segment or "." + host.rsplit(".", 1)[-1]
        domain = ".".join(host.rsplit(".", 2)[-2:]) if host.count(".") else ""
        logs = table[codes].sum(axis=0) * weight if len(codes) else [0.0] * len(langs)
        best = max(range(len(langs)), key=lambda k: logs[k]) if len(codes) else None
        made.append((i, len(codes), list(logs), best, (said or "").lower()[:2], suffix, host, domain))
    judged = [m for m in made if m[3] is not None]

    def smoothed(others, at, key, prior):
        n = collections.Counter(m[3] for m in others if m[at] == key)
        return [(n[k] + strength * prior[k]) / (sum(n.values()) + strength) for k in range(len(langs))]

    for row in made:
        i, n, logs, _, said, suffix, host, domain = row
        others = [m for m in judged if m is not row]  # a row's own decision is no evidence for it
        total = collections.Counter(m[3] for m in others)
        overall = [(total[k] + 1) / (len(others) + len(langs)) for k in range(len(langs))]
        sums = list(logs)
        for at, key in ((4, said), (5, suffix)):
            if any(m[at] == key for m in judged):
                sums = [s + math.log((sum(m[at] == key and m[3] == k for m in others) + 0.5) / (total[k] + 10.0)) for k, s in enumerate(sums)]
        if any(m[6] == host for m in judged):
            sums = [s + math.log(p) for s, p in zip(sums, smoothed(others, 6, host, smoothed(others, 7, domain, overall)))]
        top = max(sums)
        posterior = 1 / sum(math.exp(s - top) for s in sums)
        yield i, langs[sums.index(top)], posterior, n > 0 and posterior >= sure
