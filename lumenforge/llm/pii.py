"""Personal data: the contract's patterns, and a linear-chain CRF over word shapes for what patterns can't say."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, byte_slices, tidy
from .crf import LinearChainCRF

# --- the base patterns, fixed by the contract -------------------------------------------------------------

KINDS = ("email", "ip", "card", "phone", "tel", "id", "mailbox")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += _LUHN[d] if i & 1 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the pattern finds from left to right, by way of each @: the address starts where the run of local characters before it does, or where the last match ended."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            s = at
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), leftmost and not overlapping within a kind; failing matches are dropped."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


# --- the conditional random field ---------------------------------------------------------------------------

LABELS = ("O", "B-tel", "I-tel", "B-id", "I-id", "B-mailbox", "I-mailbox")
#: A token with the white space before it: letters, digits, or one mark.
_TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)", re.U)
#: Words that announce a span, stand within one, or say that a number is something else.
CUES = {
    "tel": "phone tel telephone mobile cell call fax telefon teléfono téléphone handy whatsapp ring rufen text sms móvil portable".split(),
    "id": "ssn social passport iban account acct tax nif dni nie nino ausweis passnummer konto steuer license licence permit national identity sozialversicherung passeport pasaporte reisepass cuenta compte patient".split(),
    "mail": "email mail e contact write reach correo courriel mailto inbox".split(),
    "num": "no number nr num nummer numéro número id".split(),
    "other": "version page pages chapter section figure table isbn issn order invoice ref ticket room bus line lines model part item sku build commit release issue vol volume year zip score port token kapitel seite página versión article paragraph step step row rows code tracking batch serial factura bestellung commande rechnung".split(),
    "at": ["at", "arroba", "chez"],
    "dot": ["dot", "punkt", "punto", "point"],
    "top": "com org net edu gov de fr es io uk info".split(),
    "unit": "am pm km kg cm mm mb gb ms s h usd eur euros dollars percent years days hours minutes january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec".split(),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}
#: No span of the field is without a digit, an at sign or an at word.
_LIKELY = re.compile(r"[\d@]|(?<![^\W\d_])(?:" + "|".join(CUES["at"]) + r")(?![^\W\d_])", re.I)
_MARKS = "+-()./:@#[]{}<>,;=!?'\"|$€%*"


def shape(token: str) -> str:
    """Class of a token: its cue, its digits' number, its mark, or the shape of its letters."""
    c = token[0]
    if c.isdigit():
        return f"9{min(len(token), 12)}" if token.isascii() else "9x"
    if c.isalpha():
        cue = _CUE.get(token.lower())
        if cue:
            return f"cue:{cue}"
        if len(token) <= 2 and token.isupper():
            return "XX"
        return "X" if token.isupper() else "Xx" if c.isupper() else "x"
    return token if token in _MARKS else "sym"


_SHAPES = {x: i for i, x in enumerate(["edge", *(f"cue:{k}" for k in CUES), *(f"9{n}" for n in range(1, 13)), "9x", "XX", "X", "Xx", "x", "sym", *_MARKS])}
_HEAD = np.array([{c: i for i, c in enumerate(dict.fromkeys(x[0] for x in _SHAPES))}[x[0]] for x in _SHAPES])
_DIGIT = np.array([x[0] == "9" for x in _SHAPES])
#: What a token announces: 1 for a number's word, 2 to 5 for a cue of other, tel, id or mail.
_CALLS = ("cue:other", "cue:tel", "cue:id", "cue:mail")
_NEAR = np.array([1 + _CALLS.index(x) if x in _CALLS else 0 for x in _SHAPES])
#: So many tokens back a cue counts, over line ends too.
REACH = 6
#: A token's number is its shape and, in this bit, whether it follows the last one without white space.
GLUED = 64


class _Numbers(dict):
    """Number of each token; forgets all when it gets large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        bare = token.lstrip()
        n = self[token] = _SHAPES[shape(bare)] | (GLUED if len(bare) == len(token) else 0)
        return n


def _features(parts: list[list[int]], before: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes [token, slot] of all parts' tokens, where each part starts) for the numbers of parts and of up to REACH tokens before each."""
    starts, a, c = [], [], []
    for x, b in zip(parts, before, strict=True):
        a += [0] * REACH
        c += [*[0] * (REACH - len(b)), *b, *x]
        starts.append(len(a))
        a += x
    a = np.array([*a, 0, 0])
    glued, a = a >> 6, a & (GLUED - 1)
    cue = _NEAR[np.array([*c, 0, 0]) & (GLUED - 1)]
    at = np.arange(len(a))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(cue > 0, at, -1))[:-1]])
    near = np.where((last >= 0) & (at - last <= REACH), cue[last], 0)
    back = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x[:-k]])
    on = lambda x, k: np.concatenate([x[k:], np.zeros(k, x.dtype)])
    h, g1 = _HEAD[a], on(glued, 1)
    slots = [
        a << 2 | glued << 1 | g1,
        (back(a, 1) << 6 | a) << 1 | glued,
        (a << 6 | on(a, 1)) << 1 | g1,
        back(a, 2) << 12 | back(a, 1) << 6 | h,
        h << 12 | on(a, 1) << 6 | on(a, 2),
        (back(h, 1) << 6 | h) << 6 | on(h, 1),
        near << 6 | a,
        near << 3 | _DIGIT[a] << 2 | _DIGIT[back(a, 1)] << 1 | _DIGIT[on(a, 1)],
        (back(glued, 1) << 3 | glued << 2 | g1 << 1 | on(glued, 2)) << 6 | a,
    ]
    return np.stack([x | k << 19 for k, x in enumerate(slots)], axis=1), np.array(starts)


#: The labelled table: lines as they stand in mails, forms, posts, tables and prose, spans marked {label|span}. Every 9 is any
#: digit, every Q any letter; ~ is a word or a few.
LABELLED = """
Phone: {tel|(999) 999-9999}
Tel.: {tel|999-999-9999}, Fax: {tel|999-999-9999}
Call me on {tel|07999 999999} after ~.
tel {tel|999.999.9999}
~ reach us at {tel|1-800-999-9999} for ~
Mobile no. {tel|09999/9999999}
Telefon: {tel|(0999) 999 99 99}
Téléphone : {tel|09 99 99 99 99}
Teléfono {tel|999 999 999}
Handy {tel|0999 9999999}, Büro {tel|099 999999-99}
WhatsApp {tel|9999999999}
~, {tel|(999) 999-9999} ~ ask for ~
My cell is {tel|999 999 9999}.
or ring {tel|020 9999 9999} between 9am and 9pm
{tel|999-999-9999}
{tel|(999) 999-9999}
~ | {tel|999-999-9999} | ~
{tel|09 99 99 99 99}
{tel|0999 999 9999}
~ Xx, {tel|999.999.9999}, ~
Contact Ann: {tel|(999)999-9999}
T {tel|0999 / 99 99 99} F {tel|0999 / 99 99 99}
Ms. Xx ({tel|999-999-9999})
SSN: {id|999-99-9999}
~ social security number {id|999-99-9999} ~
{id|999-99-9999}
~ | {id|999-99-9999} | ~
IBAN: {id|DE99 9999 9999 9999 9999 99}
IBAN {id|ES9999999999999999999999}
{id|FR99 9999 9999 9999 9999 9999 999}
{id|GB99 QQQQ 9999 9999 9999 99}
Transfer to {id|NL99 QQQQ 9999 9999 99}, ~
DNI {id|99999999Q}
NIE: {id|Q9999999Q}
dni: {id|99999999-Q} ~
{id|99999999Q}
Passport no. {id|Q99999999}
passport number {id|QQ9999999}, issued ~
Reisepass {id|Q99Q99Q99}
NI number {id|QQ 99 99 99 Q}
national insurance: {id|QQ999999Q}
Steuer-ID {id|99 999 999 999}
Tax ID {id|99-9999999}
account number {id|99999999}
Account no: {id|9999 9999 99}
Kontonummer {id|9999999999}
patient id {id|9999999} ~
driver's license {id|Q999-9999-9999}
driving licence {id|QQQQQ999999QQ9QQ}
write to {mailbox|anna at web dot de}
{mailbox|anna [at] web [dot] de}
email: {mailbox|j.smith(at)firm(dot)com}
mail {mailbox|info at city-hall dot org} ~
contact: {mailbox|peter AT host DOT net}
{mailbox|luis arroba correo punto es}
correo: {mailbox|ana.ruiz arroba uni punto edu}
courriel {mailbox|marie chez poste point fr}
{mailbox|first.last [at] lab.uni.edu}
~, {mailbox|kim {at} mail {dot} com}, ~
e-mail {mailbox|bob99 at server dot io}
{mailbox|max_muster (at) web (punkt) de}
reach me: {mailbox|sue <at> box <dot> org}
{mailbox|a.b at c.com}
Email {mailbox|team @ group . org}
~ ~ at ~ ~.
~ at ~, ~ at ~ ~
~ at 9:99 pm ~
met at 99 Xx Street, Xx
~ at X Xx. De ~ ~
Look at me! ~ at all
~ com ~ at ~ de ~.
I stayed at Xx. Com pare ~
AT! ~ AT ~!! NO!! AT!!
~ at the dot com bubble ~
A point at which ~ fr ~
chez Xx, ~ point ~ de ~
~ chez ~ de ~
Released under version 9.9.9
Version 9.9
licensed under the Xx License, Version 9.9.
version 9. ~
chapter 99, section 9
Figure 9.99 shows 999 of 9,999 ~
page 999-999
pp. 999-9999
on 99.99.9999 ~
9999-99-99
99/99/9999 ~
9999-99-99T99:99:99Z
99:99:99,999 --> 99:99:99,999
~ in 9999, ~ in 9999-99
between 9999 and 9999
$ 999.99
$9,999,999
€ 99,99 ~
~ 99 % ~ 9.9%
99 km, 999 kg
order 999-9999999-9999999
Order #99999999
invoice 9999-99999 ~
ISBN 999-9-99-999999-9
ISBN 9-999-99999-9
ISSN 9999-999Q
ticket 999999
~ 999.999.999.999 ~
999.999.9.9:9999
+9 (999) 999-9999
+99 99 999 9999 ~
~ user@host9.com ~
~ 9999 9999 9999 9999 ~
9999999999999999
~ 9999999999999999 ~
Xx. De 9999999999999999 ~
de 9999999999999999 la ~
X!! 9999999999999999!! X!!
99999999999999 ~
token = "9q9q9q9q9q999q9q9999999q99q99q999"
"99q99q99999q99q9q999q9999q999" ~
q99999999q q9999999qqq99q
sha 9999999q99qq9999q9
0x9QQ9 99QQ99
commit 999q9q9
id="sec-99" width="999" height="99"
x9 = 99 * y9 + 9
a[9] = b[99][999]
for i in range(999):
line 999, in ~
port 9999
room 99Q, floor 9
bus 999 to Xx
QQ-999-QQ
model Q9999
Q99 9QQ
size 99-99-99
serial QQ9999999999
SKU 99999-999
part 999-9999
zip 99999-9999
Xx, QQ 99999
score 99-99, 999-99
9-9-9-9-9-9
9 999 999 ~
99,999,999.99 ~
~ 9. ~ 99. ~ 999.
(9999) 99 (9), 999-999
doi 99.9999/9999.99.999
1. ~ 2. ~ 3. ~
[9] [99] [999]
{"a": 999, "b": [9, 99, 999.9]}
99 | 999 | 9999 | 99999
9,99 9,99 99,99
No. 9 of 99
number 999 ~
call 99 of them
account for 99 of ~
tax of 99.9 percent
social media 9999
~ mail 9 times
e.g. 999
!! ~!! 9999!! ~!! 99!!
### 99%%% ~$$$ 999&&& ~*** 9### +9 (999) 999-9999%%%
~&&& ~&&& ~%%% at$$$ ~*** the&&& ~&&& ~
~*** was&&& ~### ~&&& at%%% a&&& ~$$$ the&&& of%%%
~. The ~ es ~, from ~, fr ~. An ~ io ~
~ ~ ~ ~ ~ ~ ~ ~, ~ ~ ~. At ~ ~ ~ ~
<div id="x99"><a href="#at">~</a> & ~ | ~</div>
if (a && b || c > 9) { return x[9]; }
~ -- ~ -- 99 ~ -- ~ (~) ~ [~] ~ {~} ~
@user9 ~ #tag99 ~ @other
/path/to/file99.txt at line 99
at com.server.Xx.run(Xx.java:99)
~ | ~ | ~ | ~ | 9 | ~
| ~ | ~ | 99 | 9.9 |
""".strip().split("\n")


def training_table(seed: int = 5, repeats: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(line, spans) for training: every labelled line `repeats` times, with seeded digits, letters and words."""
    r = random.Random(seed)
    word = lambda: r.choice("the of and found about street later many said house went of la casa und der haus les maison sur".split())
    some = lambda: " ".join(r.choice([str.lower, str.lower, str.lower, str.capitalize, str.upper])(word()) + r.choice(["", "", "", ","]) for _ in range(r.randint(1, 6)))
    lower = "abcdef"

    def fill(text: str) -> str:
        out = []
        for c in text:
            if c == "9":
                out.append(r.choice("0123456789"))
            elif c == "Q":
                out.append(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ"))
            elif c == "q":
                out.append("".join(r.choice(lower) for _ in range(r.randint(1, 3))))
            elif c == "~":
                out.append(some())
            else:
                out.append(c)
        return "".join(out)

    rows = []
    for k in range(repeats):
        for line in LABELLED:
            text, spans = some() + " " if k % 3 == 2 else "", []
            at = 0
            for m in re.finditer(r"\{(tel|id|mailbox)\|((?:[^{}]|\{[^{}]*\})*)\}", line):
                text += fill(line[at : m.start()])
                value = fill(m.group(2))
                spans.append((len(text), len(text) + len(value), m.group(1)))
                text += value
                at = m.end()
            text += fill(line[at:]) + (" " + some() if k % 3 == 1 else "")
            rows.append((text, spans))
    return rows


class Tagger:
    """The trained field with its feature table; pickled to the workers."""

    #: Cells (sequences times the longest) of a padded batch, and tokens that are scored at a time.
    CELLS = 40_000

    def __init__(self, table: list[tuple[str, list[tuple[int, int, str]]]]):
        self._numbers = _Numbers()
        ids: dict[int, int] = {-1: 0}
        data = []
        for line, spans in table:
            tokens = self._places(line)
            if not tokens:
                continue
            codes, starts = _features([self.shapes(line)], [[]])
            x = [[ids.setdefault(f, len(ids)) for f in fs] for fs in codes[starts[0] : starts[0] + len(tokens)].tolist()]
            y = []
            for at, _ in tokens:
                tag = next(((lb, s) for s, e, lb in spans if s <= at < e), None)
                y.append(LABELS.index(f"{'B' if at == tag[1] else 'I'}-{tag[0]}") if tag else 0)
            data.append((np.array(x), np.array(y)))
        self.codes = np.array(sorted(ids))
        self.rows = np.array([ids[f] for f in self.codes.tolist()])
        self.crf = LinearChainCRF(len(ids), len(LABELS)).fit(data)
        for j in range(len(LABELS)):  # a span begins with B and goes on with I
            for i in range(len(LABELS)):
                if LABELS[j][0] == "I" and LABELS[i][2:] != LABELS[j][2:]:
                    self.crf.move[i, j] = -1e4
            if LABELS[j][0] == "I":
                self.crf.start[j] = -1e4

    def shapes(self, line: str) -> list[int]:
        n = self._numbers
        return [n[t] for t in _TOKEN.findall(line)]

    @staticmethod
    def _places(line: str) -> list[tuple[int, int]]:
        """(begin, end) of each token without the white space before it."""
        return [(m.end() - len(m.group().lstrip()), m.end()) for m in _TOKEN.finditer(line)]

    def last_shapes(self, text: str, end: int) -> list[int]:
        """Numbers of the last REACH tokens before a place in the text."""
        start = end
        while start > 0:
            start = max(0, start - 200)
            found = self.shapes(text[start:end])
            if len(found) > REACH or start == 0:  # the first one may be cut
                return found[-REACH:]
        return []

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """[token, label] of codes [token, slot]; bounded parts at a time, since the weights of all slots are gathered."""
        out = np.empty((len(codes), len(LABELS)))
        for s in range(0, len(codes), self.CELLS):
            part = codes[s : s + self.CELLS]
            at = np.minimum(np.searchsorted(self.codes, part), len(self.codes) - 1)
            out[s : s + self.CELLS] = self.crf.scores(np.where(self.codes[at] == part, self.rows[at], 0))
        return out

    def tag(self, lines: list[str], before: list[list[int]] | None = None) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, label) of each line, given the tokens before it; lines of like length are decoded together, so many that padding stays within CELLS."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in lines]
        shapes = [self.shapes(x) for x in lines]
        order = sorted((i for i in range(len(lines)) if shapes[i]), key=lambda i: len(shapes[i]))
        at = 0
        while at < len(order):
            part: list[int] = []
            while at < len(order) and (not part or (len(part) + 1) * len(shapes[order[at]]) <= self.CELLS):
                part.append(order[at])
                at += 1
            lengths = np.array([len(shapes[i]) for i in part])
            codes, starts = _features([shapes[i] for i in part], [before[i] if before else [] for i in part])
            inside = np.arange(lengths.max()) < lengths[:, None]
            e = np.zeros((len(part), lengths.max(), len(LABELS)))
            e[inside] = self.scores(codes[(starts[:, None] + np.arange(lengths.max()))[inside]])
            best = self.crf.decode(e, lengths)
            for k in np.flatnonzero((best > 0).any(1)).tolist():
                i, start = part[k], None
                tokens = self._places(lines[i])
                for j in range(lengths[k] + 1):
                    label = LABELS[best[k, j]] if j < lengths[k] else "O"
                    if start is not None and label[0] != "I":
                        s, e = tokens[start][0], tokens[j - 1][1]
                        if _LIKELY.search(lines[i], s, e):
                            found[i].append((s, e, LABELS[best[k, start]][2:]))
                        start = None
                    if label[0] == "B":
                        start = j
        return found


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return Tagger(training_table())


# --- the operator ---------------------------------------------------------------------------------------------

SCHEMA = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_found", T.LongType()), T.StructField("n_pii", T.LongType())])
_EMPTY = hashlib.sha256(b"").hexdigest()
_MAYBE = r"\p{Nd}|@|(?:^|\PL)(?:" + "|".join(CUES["at"]) + r")(?:\PL|$)"
#: A sequence of the field is a line's stretch around such places: from so many characters before the first to as many after the last, next blanks included.
#: Spans begin and end at such places, so none is cut; what a stretch leaves out of its line can change a label only by the chain of labels, which the
#: outside label breaks many words before. Tests decode long lines whole and in stretches, with equal spans.
MARGIN = 120
#: Characters of stretches that are decoded together.
BLOCK = 1_000_000


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the parts of text that may hold a span of the field: each place of _LIKELY with MARGIN characters either side, up to the next blank, within its line; parts that meet are one."""
    begin = end = last = -1
    for m in _LIKELY.finditer(text):
        if begin >= 0 and m.start() <= last + MARGIN and text.find("\n", last, m.start()) < 0:
            last = m.end()
            continue
        if begin >= 0:
            end = _right(text, last)
            yield begin, end
        begin, last = max(end, _left(text, m.start())), m.end()
    if begin >= 0:
        yield begin, _right(text, last)


def _left(text: str, at: int) -> int:
    line = text.rfind("\n", 0, at) + 1
    if at - MARGIN <= line:
        return line
    return max(line, text.rfind(" ", max(line, at - 2 * MARGIN), at - MARGIN) + 1, at - 2 * MARGIN)


def _right(text: str, at: int) -> int:
    line = text.find("\n", at, at + 2 * MARGIN)
    line = min(len(text), at + 2 * MARGIN) if line < 0 else line
    if line <= at + MARGIN:
        return line
    blank = text.find(" ", at + MARGIN, line)
    return line if blank < 0 else blank


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_batch(texts: pa.Array, tagger: Tagger) -> list[tuple]:
    """A row of SCHEMA for each text. A span needs a digit or an at sign or its word; RE2 picks the texts that have one."""
    rows: list[tuple] = [(0, 0, 0, 0, _EMPTY, "", 0, 0)] * len(texts)
    maybe = pc.match_substring_regex(texts, pattern=_MAYBE, ignore_case=True)
    owners: list[tuple[int, int]] = []
    parts: list[str] = []
    before: list[list[int]] = []
    held: dict[int, list[tuple[int, int, int]]] = {}
    extra: dict[int, list[tuple[int, int, int]]] = {}

    def flush() -> None:
        for (i, start), spans in zip(owners, tagger.tag(parts, before), strict=True):
            extra.setdefault(i, []).extend((s + start, KINDS.index(label), e + start) for s, e, label in spans)
        for i, base in held.items():
            taken, more = sorted(base), []
            for s, k, e in extra.get(i, []):
                at = bisect_left(taken, (e, 0, 0))
                # spans of a kind don't overlap, so what may reach into s stands within the last few before it
                if not any(a < e and s < b for a, _, b in taken[max(0, at - 8) : at]):
                    more.append((s, k, e))
            if base or more:
                n = [sum(k == j for _, k, _ in base) for j in range(4)]
                rows[i] = (*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more), len(base) + len(more))
        for x in (owners, parts, before, held, extra):
            x.clear()

    size = 0
    for i in pc.indices_nonzero(maybe).to_pylist():
        text = texts[i].as_py()
        held[i] = base_spans(text)
        for start, end in stretches(text):
            owners.append((i, start))
            parts.append(text[start:end])
            before.append(tagger.last_shapes(text, start))
            size += end - start + 50
        if size > BLOCK:
            flush()
            size = 0
    flush()
    return rows


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_pii) of every row: n_found counts the spans of the field, n_pii all.

    A null text counts as empty: no spans. Ids may be null or repeated, and each row has its own result; other columns,
    whatever their names, are not looked at; an empty table gives no rows. Texts of any length are read whole; what is held at a time
    grows with the longest text, not with the batch. Spans of the field (tel, id, mailbox) that touch a base span
    are left out; spans that begin together are ordered by kind. The
    field is trained on the driver from the small labelled table and its weights travel with the
    function; one narrow pass over Arrow batches, nothing is shuffled.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    schema = T.StructType([T.StructField(id_col, kind), *SCHEMA.fields])
    tagger = trained() if table is None else Tagger(table)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64()]
        for whole in batches:
            for start, end in byte_slices(whole.column(1)):
                b = whole.slice(start, end - start)
                columns = zip(*scan_batch(b.column(1), tagger), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=schema.names)

    return slim.mapInArrow(run, schema)
