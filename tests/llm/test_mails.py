"""New text by example, and the trees."""

import numpy as np
from datetime import datetime

from docuplane.llm import mails as M

SENDER = "Alice Orlpe <alice.orlpe@x.example>"
OLD = "Hello Alice\n\nThe harbour was closed on the second day after the storm.\n\nBest,\nBob Kvist\n--\nBob Kvist\nphone 555-0001"
NEW = {
    "plain": ("Hi Bob,\r\n\r\nWe open it again tomorrow.\r\n\r\nKind regards\r\nAlice\r\n--\r\nAlice Orlpe\r\nClaims desk, Room 2.17\r\nTel. +00 555 0004\r\n", [1, 3]),
    "quoted": ("Yes please.\n\nOn Fri, 9 Jan 2015 at 04:43, Bob Kvist wrote:\n> Hello Alice\n>\n> The harbour was closed on the second day after the\nstorm.\n>\n> Best,\n> Bob Kvist\n", [1]),
    "between": ("Bob Kvist (bob@x.example) writes:\n| The harbour was closed on the second day\n\nNot any more, it opens at noon tomorrow.\n\n| after the storm.\n", [4]),
    "forward": ("See below, all of it is ours now.\n\n-----Original Message-----\nFrom: Bob Kvist <bob@x.example>\nSent: Fri\nTo: a@x.example\nSubject: s\n\n" + OLD, [1]),
    "notices": ("+1\n\nSent from my phone\n* * *\nThis message and any files with it are meant only for the addressee. If it reached you by\nmistake, tell the sender and delete it.\n", [1]),
    "traps": ("Thanks, our harbour is open since the second hour of today.\n\n-- our draft is done and has been sent to all of them.\n\nConfidential as it is, the report went to the printer today.\n\nOn Tuesday I wrote: nothing new, and that still holds today.\n\n> 300 files are still open. each of them needs a second look before\nthe end of the week is here.\n", [1, 3, 5, 7, 9, 10]),
    "only quotes": ("> a\n> b\n", []),
    "blank": (" \n \n", []),
    "none": (None, []),
}


def rows():
    at = datetime(2024, 1, 2)
    out = [("old", "<m0@x>", None, None, "Bob Kvist <bob@x.example>", OLD, datetime(2024, 1, 1))]
    for i, (k, (t, _)) in enumerate(NEW.items()):
        out.append((k, f"m{i + 1}@x", "<m0@x>", ["m0@x"] if i % 2 else None, SENDER, t, at))
    # enough of the ordinary to learn from
    for i in range(120):
        t = f"Dear Bob,\n\nItem {i} was moved to shelf {i * 7} in the hall {i % 5}.\n\nok\n\nBest regards,\nAlice\n\nSent from my phone\n\nOn Fri, 9 Jan 2015 at 04:43, Bob Kvist wrote:\n> old line {i} of text\n"
        out.append((f"z{i}", f"z{i}@x", None, [], SENDER, t, at))
    return out


SCHEMA = "doc_id string, message_id string, in_reply_to string, refs array<string>, email_from string, content string, sent_at timestamp"


def test_new_lines(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {}
    for r in M.newly_written(df).collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    assert {k: sorted(got.get(k, [])) for k in NEW} == {k: v for k, (_, v) in NEW.items()}
    assert all(sorted(got[f"z{i}"]) == [1, 3, 5] for i in range(120))


def test_empty(spark):
    assert M.newly_written(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.newly_written(spark.createDataFrame([("a", None, None, None, None, None, None)], SCHEMA)).count() == 0


def test_trees():
    """Held-out accuracy on a rule the trees don't know."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = M.Trees(depth=3).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97
    assert (M.Trees().fit(x[:10], np.ones(10)).score(x[:3]) > 0).all() and len(M.Trees().fit(x[:0], y[:0]).score(x[:3])) == 3
