"""Lines written by hand, not by the generator of the labelled table: what the CRF adds to the patterns, by precision and recall."""

import numpy as np
import pytest

from quarrylens.llm import pii

# fmt: off
#: The generator's forms were widened with these in view.
LINES = [
 ("You can reach the front desk at (212) 555-0147 after nine.", [("(212) 555-0147","phone")]),
 ("Fax: 212-555-0188, ask for Marta.", [("212-555-0188","phone")]),
 ("My new number is 646.555.0123 so please update it.", [("646.555.0123","phone")]),
 ("Text 415 555 2671 if you are late.", [("415 555 2671","phone")]),
 ("Tel (030) 555-2211. Office hours 9 to 5.", [("(030) 555-2211","phone")]),
 ("Call 1-800-555-0199 toll free.", [("1-800-555-0199","phone")]),
 ("Mobile (917)555-0102 or leave a note.", [("(917)555-0102","phone")]),
 ("the landlord's phone is 503-555-0160 and he rarely answers", [("503-555-0160","phone")]),
 ("write to jane.doe [at] example [dot] org for the schedule", [("jane.doe [at] example [dot] org","email")]),
 ("contact: sam (at) books (dot) net", [("sam (at) books (dot) net","email")]),
 ("Send it to m.ruiz (at) uni-koeln (dot) de, please.", [("m.ruiz (at) uni-koeln (dot) de","email")]),
 ("admin[at]server[dot]com handles accounts", [("admin[at]server[dot]com","email")]),
 ("orders(at)shop(dot)net is read daily", [("orders(at)shop(dot)net","email")]),
 ("The gateway is 10[.]0[.]12[.]7 and it drops packets.", [("10[.]0[.]12[.]7","ip")]),
 ("traffic came from 203[.]0[.]113[.]45, then stopped", [("203[.]0[.]113[.]45","ip")]),
 ("block 198[dot]51[dot]100[dot]9 at the edge", [("198[dot]51[dot]100[dot]9","ip")]),
 ("Charge it to 4111.1111.1111.1111 as before.", [("4111.1111.1111.1111","card")]),
 ("card no 5500.0000.0000.0004 exp 09/27", [("5500.0000.0000.0004","card")]),
 ("Phone: (510) 555-0133\tRoom 14", [("(510) 555-0133","phone")]),
 ("numbers 212-555-0101 and 212-555-0102 are both mine", [("212-555-0101","phone"),("212-555-0102","phone")]),
 ("Invoice 2023-114-0098 is overdue.", []),
 ("The match ended 3-2 after 120 minutes on 14.05.2019.", []),
 ("ISBN 978-3-16-148410-0 is out of print", []),
 ("Version 2.14.3.1092 fixes the bug", []),
 ("Order #10023344 shipped 2021-11-30 at 14:05:22", []),
 ("population 1 204 331 in the last census", []),
 ("The budget rose from 1,200,000 to 1,350,500 euros", []),
 ("sha 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", []),
 ("tracking 1Z999AA10123456784 left the depot", []),
 ("coordinates 52.5200 13.4050 mark the gate", []),
 ("Follow @nightowl for updates", []),
 ("flight LH 1234 departs at 06:45 from gate 22", []),
 ("pages 100-104 and 220-225 were torn", []),
 ("SSN-like ids such as 000-12-3456 are not phones", []),
 ("meet (at) the station (dot) no mail here", []),
 ("pi is 3.14159265358979 roughly", []),
 ("rows 10 20 30 40 50 60 70 80", []),
 ("ratio 16:9, 1920x1080, 60 fps", []),
 ("chapter 12 section 3.4.5 clause 2", []),
 ("serial 4000-1234-5678-9999 printed on the box", []),
]
#: These were not looked at for that.
EVAL = [
 ("Ring 020 555 0147 or come by", [("020 555 0147","phone")]),
 ("Doctor: (718) 555-0190; pharmacy: 718-555-0191.", [("(718) 555-0190","phone"),("718-555-0191","phone")]),
 ("his cell, 305.555.0177, was off", [("305.555.0177","phone")]),
 ("press (at) gallery [dot] org answers within a day", [("press (at) gallery [dot] org","email")]),
 ("billing[at]hosting.net or support(at)hosting(dot)net", [("billing[at]hosting.net","email"),("support(at)hosting(dot)net","email")]),
 ("The resolver at 9(.)9(.)9(.)9 timed out", [("9(.)9(.)9(.)9","ip")]),
 ("logs show 172[.]16[.]254[.]1 twice", [("172[.]16[.]254[.]1","ip")]),
 ("paid with 6011.0009.9013.9424 yesterday", [("6011.0009.9013.9424","card")]),
 ("Between 1914 and 1918 the mill made 12 500 tons", []),
 ("lat 48.8566 long 2.3522 near the river", []),
 ("case 21-CV-10042 was closed on 03/04/2022", []),
 ("0.5 to 1.5 mg per 100 ml, 3 times a day", []),
 ("bus 212 stops 555 m from the school", []),
 ("build 10.0.19041.1288 of the system", []),
 ("part no. 555-0147-22 does not fit", []),
]
# fmt: on


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_table())


@pytest.mark.parametrize(("lines", "least_recall"), [(LINES, 0.9), (EVAL, 0.85)])
def test_added_spans_of_handmade_lines(model, lines, least_recall):
    right = wrong = missed = 0
    for (text, want), spans in zip(lines, pii.find_all([t for t, _ in lines], model), strict=True):
        got = [(text[a:b], k) for a, b, k, base in spans if not base]
        right += sum(g in want for g in got)
        wrong += sum(g not in want for g in got)
        missed += sum(w not in got for w in want)
    print(f"precision {right / (right + wrong):.2f} recall {right / (right + missed):.2f}")
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= least_recall


def plain_viterbi(model, words):
    u = model.scores(pii._features(words))
    best, back = u[0], []
    for row in u[1:]:
        step = best[:, None] + model.move
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_long_chains_and_words_are_whole(model, monkeypatch):
    r = np.random.default_rng(2)
    words = [f"{a}-{b:03}" if c else str(b) for a, b, c in zip(r.integers(100, 999, 6000), r.integers(0, 10_000, 6000), r.random(6000) < 0.4, strict=True)]
    assert model.decode([model.chain_scores(words), model.chain_scores(words[:7])])[0].tolist() == plain_viterbi(model, words)
    text = " ".join(words)
    assert [x[:3] for x in pii.find_all([text], model)[0]] == [x[:3] for x in pii.find_all(["", text], model)[1]]
    monkeypatch.setattr(pii, "FEATURE_WORDS", 5)
    monkeypatch.setattr(pii, "DECODE_WORDS", 10)
    assert model.decode([model.chain_scores(words[:40]), model.chain_scores(words[:3])])[0].tolist() == plain_viterbi(model, words[:40])
    assert pii._shape("1" + "a" * 30 + "-" + "2") == "dxxxx-d"  # of the whole word


def test_leading_zeros(model):
    zeros = "0" * 5000
    assert pii.base_spans(zeros + ".1.1.1") == [(0, 5006, "ip")] and pii.base_spans("1.2.3." + zeros + "256") == []
    assert pii.find_all([zeros + ".1.1.1"], model)[0] == [(0, 5006, "ip", True)]
