"""Personal data: exact patterns, and spans that a linear-chain conditional random field adds.

The patterns (email, ip, card, phone) are matched leftmost and non-overlapping for each kind; matches that fail their kind's
test go, without another try. The field reads the words of a line by their shapes - letters, digits and marks with runs
shortened, digit counts, checksum and octet tests, and the shapes and cue words beside them - and labels words that hold a
digit or an @; all other words are outside by construction, so a line falls into independent runs of such words. It is trained
on the driver from the small table below by gradient ascent, and decoded by Viterbi in numpy, many runs at once. Its spans
are added where they overlap no pattern's span.

Offsets count code points; ends are exclusive. A null text is empty; long texts and words are read whole. Where spans of a kind
could tie, the leftmost one is taken. Equal rows are handled separately. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The patterns of the four kinds. Quantifiers that can't usefully give back are possessive.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAYBE = re.compile(r"[0-9@]")

# The labelled table. [kind text] marks a span; all else is outside.
TRAINING = """
write to [email jane.roe@example.org] about the order
our address is [email info@mail.example.com] for all questions
mail [email a.b-c+news@lists.example.net], not the old one
contact: [email team_7@dev.example.io].
two people, [email x1@example.com] and [email y2@example.com], replied
und [email kontakt@firma.example.de] steht darunter
the login name @jane is not an address
see @42 in thread 17 and reply @ noon
send it to [email sales@example.co.uk]!! today
this price @ 30 each holds for 12 boxes
the server at [ip 192.168.0.12] is down
ping [ip 10.0.0.1] and [ip 10.0.0.254] from here
host [ip 203.0.113.77], port 8080
requests from [ip 8.8.4.4]. were blocked
les adresses [ip 172.16.5.9] et [ip 172.16.5.10] sont prises
version 1.2.3 of the tool and release 4.10.0.1b came out
chapter 3.4.5 follows section 2.1
the build 999.999.999.999 is no address
update to 2.0. and later to 2.0.1.
card number [card 4111 1111 1111 1111] was declined
pay with [card 4012888888881881] please
[card 5500-0000-0000-0004] expires in 2031
tarjeta [card 4242 4242 4242 4242], gracias
card [card 5105105105105100]. ok
order 4111111111111112 has shipped
tracking id 9400110200881234567890 arrived
the key "8f14e45fceea167a5a36dedd4bea2543" must stay secret
hash 900150983cd24fb0d6963f7d28e17f72 of the file
invoice 2024 0001 0002 0003 is open
serial 1234567890123456 and lot 77
call [phone +1 (555) 010-1234] after noon
tel [phone +49 30 901820] ext 12
reach me on [phone +44 20 7946 0958], thanks
phone: [phone (555) 010-9876]
call [phone (212) 555-0147] or write
my number is [phone 555-010-4477]
ring [phone 020-7946-0123] tonight
fax [phone +33 1 70 18 99 00].
llama al [phone +34 912 345 678] hoy
call [phone 555-0199] now
text [phone +1 415-555-2671]!! soon
in 1984 about 300 people lived there
from 10 to 12 on 2024-05-06 at 18:30
the sum was 1,234.56 or 99 percent
pages 100-120 and 200-230 are missing
room 12-3456 on floor 7
item 55-1212 costs 3.50
scores of 3-2 and 10-9 in 2019
part 123-4567 fits the pump
width 20.5 height 30.25 depth 4
a 4736 b 99 c 18.
licensed under version 2.0. since 2004
chapter 12 verse 3
the years 1990-1999 and 2000-2009
between 1.5 and 2.5 of 40
area (017) of map 12
ratio 555/7713 in row 8
""".strip().splitlines()
#: Steps and size of the gradient ascent, and the weight of the squared norm.
STEPS, RATE, DECAY = 300, 0.5, 0.01


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) if c < "5" else 2 * int(c) - 9) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind in the order of KINDS, then by start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at and at >= done else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return out


def shape(word: str) -> str:
    """Letters as a or A with runs as one, digits as 9 with runs of up to 4, everything else as it is."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", word.rstrip(",;:!?\"'#$%&*|"))
    return re.sub(r"[0-9]+", lambda m: "9" * min(4, len(m[0])), s)


CUES = frozenset("call tel phone phone: fax ring text number mail write contact: card pay tarjeta ping host server at from version chapter page pages in order id serial key hash".split())


def features(words: list[str], i: int) -> list[str]:
    w = words[i]
    d = digits_of(w)
    near = lambda j: shape(words[j]) if 0 <= j < len(words) and MAYBE.search(words[j]) else "word" if 0 <= j < len(words) else "edge"
    before = words[i - 1].lower() if i else ""
    own, left, right = shape(w), near(i - 1), near(i + 1)
    out = ["bias", f"s={own}", f"n={min(len(d), 20)}", f"-1={left}", f"+1={right}", f"c={before if before in CUES else ''}", f"-1s={left}|{own}", f"s+1={own}|{right}"]
    if "@" in w:
        out.append("at" if DOMAIN.search(w.split("@", 1)[1]) and not w.startswith("@") else "at-alone")
    if len(d) >= 13:
        out.append("luhn" if luhn(d) and not re.search(r"[A-Za-z]", w) else "not-luhn")
    if IP.search(w):
        out.append("octets" if any(k == "ip" for k, *_ in pattern_spans(w)) else "not-octets")
    if w.startswith("+"):
        out.append("plus")
    if w.startswith("("):
        out.append("open")
    return out


def runs(words: list[str]) -> list[tuple[int, int]]:
    """Maximal runs of words that hold a digit or an @."""
    out = []
    for i, w in enumerate(words):
        if MAYBE.search(w):
            if out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in TRAINING:
        words, labels = [], []
        for kind, span, mark, plain in re.findall(r"\[(\w+) ([^\]]*)\](\S*)|(\S+)", line):
            for k, w in enumerate((span + mark).split() if kind else [plain]):
                words.append(w)
                labels.append(LABELS.index(f"{'I' if k else 'B'}-{kind}") if kind else 0)
        out.append((words, labels))
    return out


class Field:
    """emit: weights of features for each label; move: of label pairs; begin and end: of the first and last label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.names, self.emit, self.move, self.begin, self.end = names, emit, move, begin, end
        self._known: dict[tuple, np.ndarray] = {}

    def scores(self, words: list[str], s: int, e: int) -> np.ndarray:
        return np.array([self.emit[[self.names[f] for f in features(words, i) if f in self.names]].sum(axis=0) for i in range(s, e)])

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each run, by Viterbi over runs of similar length together."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(batch)
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        for lo in range(0, len(order), 512):
            part = order[lo : lo + 512]
            size = np.array([len(batch[i]) for i in part])
            most = int(size.max())
            x = np.zeros((len(part), most, len(LABELS)))
            for r, i in enumerate(part):
                x[r, : size[r]] = batch[i]
            best = x[:, 0] + self.begin
            back = np.zeros((most, len(part), len(LABELS)), np.int8)
            for t in range(1, most):
                paths = best[:, :, None] + self.move[None]
                back[t] = paths.argmax(1)
                new = paths.max(1) + x[:, t]
                best = np.where((t < size)[:, None], new, best)
            last = (best + self.end).argmax(1)
            path = np.zeros((len(part), most), int)
            rows = np.arange(len(part))
            for t in range(most - 1, -1, -1):
                on = t < size
                path[on, t] = last[on]
                if t:
                    last = np.where(on, back[t][rows, last], last)
            for r, i in enumerate(part):
                out[i] = path[r, : size[r]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


@functools.lru_cache(maxsize=1)
def field() -> Field:
    """Trains on the table: exact gradients of the log likelihood by forward and backward sums, all runs at once."""
    seqs = [([features(words, i) for i in range(s, e)], labels[s:e]) for words, labels in labelled() for s, e in runs(words)]
    names: dict[str, int] = {}
    for fs, _ in seqs:
        for f in fs:
            for n in f:
                names.setdefault(n, len(names))
    size = np.array([len(y) for _, y in seqs])
    n, most, k = len(seqs), int(size.max()), len(LABELS)
    x = np.zeros((n, most, len(names)))
    y = np.zeros((n, most), int)
    for i, (fs, labels) in enumerate(seqs):
        y[i, : size[i]] = labels
        for t, f in enumerate(fs):
            x[i, t, [names[a] for a in f]] = 1
    on = np.arange(most)[None, :] < size[:, None]
    rows = np.arange(n)
    gold = np.eye(k)[y] * on[:, :, None]
    emit, move, begin, end = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)
    sums = [np.full(p.shape, 1e-6) for p in (emit, move, begin, end)]
    for _ in range(STEPS):
        u = x @ emit
        a, b = np.zeros((n, most, k)), np.zeros((n, most, k))
        a[:, 0] = u[:, 0] + begin
        for t in range(1, most):
            a[:, t] = np.where(on[:, t, None], _lse(a[:, t - 1, :, None] + move[None], 1) + u[:, t], a[:, t - 1])
        z = _lse(a[:, -1] + end, 1)
        b[:, most - 1] = end
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(on[:, t + 1, None], _lse(move[None] + (u[:, t + 1] + b[:, t + 1])[:, None, :], 2), end)
        p = np.exp(a + b - z[:, None, None]) * on[:, :, None]
        gmove = np.zeros((k, k))
        for t in range(1, most):
            live = on[:, t]
            pair = np.exp(a[live, t - 1, :, None] + move[None] + (u[live, t] + b[live, t])[:, None, :] - z[live, None, None])
            gmove += np.einsum("ni,nj->ij", gold[live, t - 1], gold[live, t]) - pair.sum(0)
        d = gold - p
        grads = (np.einsum("ntf,ntk->fk", x, d), gmove, d[:, 0].sum(0), d[rows, size - 1].sum(0))
        for w, s, g in zip((emit, move, begin, end), sums, grads):
            g = g - DECAY * w
            s += g * g
            w += RATE * g / np.sqrt(s)
    for i, label in enumerate(LABELS):  # I- follows its own kind only
        if label[0] == "I":
            begin[i] = -1e4
            for j, other in enumerate(LABELS):
                if other[2:] != label[2:] or other == "O":
                    move[j, i] = -1e4
    return Field(names, emit, move, begin, end)


EDGES = ",;:!?\"'#$%&*|"


def field_spans(texts: list[str], model: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of the field in each text, without marks around them."""
    where, batch = [], []
    for i, text in enumerate(texts):
        if not MAYBE.search(text):
            continue
        start = 0
        for line in text.split("\n"):
            if MAYBE.search(line):
                at = [(m.start() + start, m.end() + start) for m in re.finditer(r"\S+", line)]
                words = [text[s:e] for s, e in at]
                for s, e in runs(words):
                    where.append((i, at[s:e]))
                    batch.append(model.scores(words, s, e))
            start += len(line) + 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, at), labels in zip(where, model.decode(batch) if batch else []):
        t = 0
        while t < len(labels):
            end = t + 1
            if labels[t]:
                while end < len(labels) and LABELS[labels[end]][0] == "I":
                    end += 1
                s, e = at[t][0], at[end - 1][1]
                while s < e and texts[i][s] in EDGES:
                    s += 1
                while e > s and texts[i][e - 1] in EDGES + ".":
                    e -= 1
                if s < e:
                    out[i].append((LABELS[labels[t]][2:], s, e))
            t = end
    return out


def _text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the patterns) and spans (all spans), each as kind:start:end by kind, then start, comma-joined."""
    model = df.sparkSession.sparkContext.broadcast(field())
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [pattern_spans(t) if MAYBE.search(t) else [] for t in texts]
                every = []
                for own, more in zip(base, field_spans(texts, model.value)):
                    taken = sorted((s, e) for _, s, e in own)
                    starts, ends = np.array([s for s, _ in taken], np.int64), np.maximum.accumulate([e for _, e in taken]) if taken else np.empty(0)
                    free = [x for x in more if not (k := int(np.searchsorted(starts, x[2]))) or ends[k - 1] <= x[1]]
                    every.append(sorted([*own, *free], key=lambda x: (rank[x[0]], x[1], x[2])))
                yield pa.record_batch([part.column(0), pa.array(map(_text, base), pa.string()), pa.array(map(_text, every), pa.string())], names=["doc_id", "base", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, base string, spans string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone (counts of the patterns' spans), base_sha256, spans."""
    found = find_pii(table(spark, "documents")(sf_dir))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
