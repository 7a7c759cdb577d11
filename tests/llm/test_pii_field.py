"""The field on lines written by hand, apart from its training table; memory on lines of mixed lengths; all spans of whole texts."""

from __future__ import annotations

import random
import re
import tracemalloc

import pyarrow as pa

from lumenforge.llm import pii

#: Lines as people write them, spans marked {label|span}.
HELD_OUT = """
Hi Tom, my new number is {tel|415-555-0132}, text me when you land.
For bookings call {tel|(212) 555-0187} or visit the front desk.
Dr. Helga Brandt, Praxis am Markt, Tel. {tel|030 5550 1298}
Vous pouvez me joindre au {tel|06 12 34 56 78} après 18 h.
Llámame al {tel|612 345 678} mañana por la tarde.
Emergency contact: Maria Lopez, {tel|555.867.5309}
FAX {tel|(303) 555-0149} ATTN: billing
Office: {tel|617-555-0173} Cell: {tel|617-555-0174}
He left a voicemail from {tel|702-555-0115} on Monday.
Rufen Sie uns an unter {tel|0221 5551234}.
Customer service {tel|1-888-555-0122} (toll free)
telephone: {tel|01632 960983}
Name: Jane Roe | Phone: {tel|5035550188} | City: Salem
The applicant's SSN is {id|078-05-1120} according to the form.
Social Security # {id|219-09-9999}
SSN {id|457-55-5462}, DOB 04/12/1987
Please wire the deposit to IBAN {id|DE89 3704 0044 0532 0130 00} by Friday.
Meine IBAN lautet {id|DE02120300000000202051}.
IBAN: {id|GB29 NWBK 6016 1331 9268 19}
IBAN {id|FR14 2004 1010 0505 0001 3M02 606}
DNI del titular: {id|12345678Z}
con NIE {id|X1234567L} y domicilio en Madrid
My passport number is {id|C01234567} and it expires in May.
Passport No: {id|533380006}
NINO {id|AB 12 34 56 C}
Steuernummer {id|12 345 678 901}
account no. {id|00123456} sort code 20-00-00
you can write to me: {mailbox|john dot doe at example dot com}
email {mailbox|sarah [at] example [dot] org} for the slides
Contact: {mailbox|webmaster (at) uni-koeln (dot) de}
mail me at {mailbox|helpdesk AT campus DOT edu}
mi correo es {mailbox|pepe arroba ejemplo punto com}
{mailbox|support at shop dot net}
{mailbox|k.meier [at] posteo [dot] de}, Fragen gern per Mail
The committee met at 10:30 and adjourned at 12:15.
We arrived at the station at noon and left at dusk.
Apollo 11 landed on July 20, 1969, at 20:17 UTC.
Revenue rose 12.4% to $1,234,567 in fiscal 2019.
See section 4.2.1, figures 3-7 and table 12.
The population was 83,129,285 in 2021.
ISBN 978-3-16-148410-0 is out of print.
Build 20210607.1234 failed with exit code 137.
Version 10.15.7 fixes CVE-2021-30860.
The score was 21-14, 17-21, 15-12.
Released 2020-03-15 under GPL v3.
Flight LH 441 departs from gate B 22.
He ran 42.195 km in 2:01:39.
Pi is roughly 3.14159265358979.
order 112-3487123-9912345 has shipped
Model XR-5500 weighs 12.5 kg and costs 299 euros.
UUID 550e8400-e29b-41d4-a716-446655440000
md5: d41d8cd98f00b204e9800998ecf8427e
Mix 250 g flour, 2 eggs and 100 ml milk at 180 degrees.
Room 204, 3rd floor, 9-5 weekdays
The 1990s saw 4 recessions in 6 countries.
Latitude 52.5200, longitude 13.4050
Sold 4500 of 12000 units at 19.99 each
Tuesdays at 7, doors at 6:30
He aimed at the dot com market at large.
Chez Pierre, menu at 35 euros, no cards.
for (int i = 0; i < 1024; i++) sum += a[i] * 31;
Track 07 - 03:45 - 192 kbps
Chapter 12: pages 233-241
Isaiah 40:31; Psalm 23:1-6
Act III, scene 2, line 78
1 2 3 4 5 6 7 8 9 10
GET /index.html HTTP/1.1 200 5316
192.168.1.1 answered in 23 ms
E = mc2, F = 9.81 N, 6.022e23
Look at that! At last, at least 3 of them.
VAT 19 % incl., total 1.249,00 EUR
Highway 101 North, exit 398B
size 42, colour 0xFF00AA
temperatures between -5 and 12
""".strip().split("\n")


def _marked(line):
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(tel|id|mailbox)\|([^}]*)\}", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m.group(2)), m.group(1)))
        text += m.group(2)
        at = m.end()
    return text + line[at:], spans


def held_out_scores():
    """(precision, recall) over whole spans with their labels."""
    lines = [_marked(x) for x in HELD_OUT]
    got = {(i, *s) for i, spans in enumerate(pii.trained().tag([t for t, _ in lines])) for s in spans}
    want = {(i, *s) for i, (_, spans) in enumerate(lines) for s in spans}
    return len(got & want) / max(1, len(got)), len(got & want) / len(want), got - want, want - got


def test_field_on_lines_of_another_hand():
    precision, recall, _, _ = held_out_scores()
    assert precision >= 0.9 and recall >= 0.85  # 0.94 and 0.89 when written


def test_memory_on_mixed_line_lengths():
    r = random.Random(3)
    short = [f"{r.randint(0, 99)} of {r.randint(0, 99)}" for _ in range(3000)]
    text = "\n".join([*short, " ".join(str(r.randint(0, 9999)) for _ in range(20000)), "word " * 100_000 + "SSN: 123-45-6789"])
    tagger = pii.trained()
    tracemalloc.start()
    (row,) = pii.scan_batch(pa.array([text]), tagger)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    at = text.index("123-45")
    assert f"id:{at}:{at + 11}" in row[5].split(",")


def test_stretches_cover_every_place():
    r = random.Random(8)
    for _ in range(400):
        text = "".join(r.choice(["a", " ", " ", "\n", "word " * 40, "x" * 300, "7", "@", " at ", "é"]) for _ in range(r.randint(0, 25)))
        parts = list(pii.stretches(text))
        assert all(a < b for a, b in parts) and all(b <= c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))
        assert all("\n" not in text[a:b] for a, b in parts)
        for m in pii._LIKELY.finditer(text):
            assert any(a <= m.start() and m.end() <= b for a, b in parts), (text, m.start())


def test_span_after_a_cue_on_the_line_before():
    lines = "Phone:\n(415) 555-0132\nnothing else"
    (row,) = pii.scan_batch(pa.array([lines]), pii.trained())
    assert row[5] == "tel:7:21" and row[6:] == (1, 1)


def test_stretches_decode_as_whole_lines_do(monkeypatch):
    """On long lines the field finds the same spans whether it reads the line whole or the stretches around likely places."""
    r = random.Random(9)
    plain = [re.sub(r"\{\w+\|([^}]*)\}", r"\1", x) for x in HELD_OUT]
    filler = "the river of an old town and its people were known for bread wool music after long winter many came to work".split()
    lines = []
    for _ in range(60):
        parts = []
        for x in r.sample(plain, 3):
            parts += [x, " ".join(r.choice(filler) for _ in range(r.choice([5, 40, 90])))]
        lines.append(" ".join(parts))
    cut = pii.scan_batch(pa.array(lines), pii.trained())
    monkeypatch.setattr(pii, "MARGIN", 1 << 30)
    whole = pii.scan_batch(pa.array(lines), pii.trained())
    assert sum(len(list(pii.stretches(x))) == 1 for x in lines) == len(lines)
    differ = [k for k in range(len(lines)) if cut[k][5] != whole[k][5]]
    assert not differ, [(lines[k], cut[k][5], whole[k][5]) for k in differ[:2]]
