import datetime
import json

import pytest

from docsql.llm import conversations, ocr, pages, pii, splitting


@pytest.mark.parametrize("size, overlap", [(50, 10), (80, 0), (30, 15), (1200, 150)])
def test_cuts(size, overlap):
    text = "# Head\n\nFirst sentence here. Second one, a little longer than that.\nA line.\n\n" + "x" * 140 + "\n\n" + "word " * 60
    at = splitting.cuts(text, size, overlap)
    assert at[0] == 0 and at[-1] == len(text) and at == sorted(set(at))
    if len(text) > size:
        assert all(z - a <= size - overlap for a, z in zip(at, at[1:]))


def test_natural_boundary():
    text = "a" * 40 + ". " + "b" * 30 + "\n\n" + "c" * 70
    assert splitting.cuts(text, 100, 0)[1] == text.index("c")


def test_split_texts(spark):
    o = spark.createDataFrame([("s", 20, 5), ("n", None, None), ("w", 10, 9)], "collection string, size int, overlap int")
    t = datetime.datetime(2026, 1, 1)
    rows = [("a", "s", "one two three four five six", t), ("a", "s", "one two three four five six", t), ("b", "s", " \r\n\tshort\r\n", t), ("c", None, "y" * 1201, t), ("d", "zzz", "w " * 700, t), ("e", "s", None, t), ("f", "s", " \n", t), ("g", "n", "v " * 500, t), ("h", "w", "aaa bbb ccc ddd", t), (None, "s", "x" * 99, t)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, collection string, content string, received_at timestamp, pieces string")
    assert {tuple(r) for r in splitting.oversized(df, o).collect()} == {("a", "plain"), ("c", "run"), ("d", "plain"), ("h", "plain")}
    out: dict = {}
    for r in splitting.pieces(df, o).orderBy("id", "ordinal").collect():
        out.setdefault(r["id"], []).append(r)
    assert [p["piece"] for p in out["b"]] == ["short"] and "e" not in out and "f" not in out
    for i, text, size in (("a", "one two three four five six", 20), ("c", "y" * 1201, 1200), ("d", ("w " * 700).strip(), 1200)):
        joined = out[i][0]["piece"]
        for p in out[i][1:]:
            k = len(joined) - p["start_at"]
            assert joined.endswith(p["piece"][:k])
            joined += p["piece"][k:]
        assert joined == text and all(len(p["piece"]) <= size for p in out[i])
    assert splitting.pieces(df.where("false"), o).count() == 0


def message(role, content=None, **more):
    return json.dumps({"role": role, "content": content} | more)


CASES = {
    "ok": [("user", "q"), ("assistant", "a")],
    "ok_case": [(" USER", "q"), ("Assistant ", "a")],
    "two_users": [("user", "q"), ("user", "r"), ("assistant", "a")],
    "open": [("user", "q"), ("assistant", "a"), ("user", "r")],
    "blank_reply": [("user", "q"), ("assistant", " \n")],
    "starts_wrong": [("assistant", "a"), ("user", "q"), ("assistant", "b")],
    "blank": [("user", ""), ("assistant", None)],
    "role": [("user", "q"), ("bot", "a")],
    "tool_ok": [("user", "q"), ("assistant", "", {"toolCalls": [{"id": "c"}]}), ("tool", "r", {"toolCallId": "c"}), ("assistant", "a")],
    "tool_late": [("user", "q"), ("tool", "r", {"toolCallId": "c"}), ("assistant", "a", {"toolCalls": [{"id": "c"}]})],
    "tool_none": [("user", "q"), ("tool", "r"), ("assistant", "a")],
    "typed": [("user", "q"), ("assistant", 5)],
    "synthetic_text": [("user", "q"), ("assistant", "a"), ("user", "go on", {"synthetic": "true"})],
    "synthetic": [("user", "q"), ("assistant", "a"), ("user", "go on", {"synthetic": True})],
}
EXPECTED = {"typed": "no_reply", "synthetic_text": "no_reply", "two_users": "no_reply", "open": "no_reply", "blank_reply": "no_reply", "starts_wrong": "broken", "blank": "empty", "role": "broken", "tool_late": "broken", "tool_none": "broken", "unknown": "broken", "silent": "empty", "garbage": "broken", "array": "broken", "cut": "broken", "null": "broken"}


def conversation_rows():
    t = datetime.datetime(2026, 1, 1)
    rows, n = [], 0
    for thread, turns in CASES.items():
        for i, turn in enumerate(turns):
            n += 1
            rows.append((n, thread, message(turn[0], turn[1], **(turn[2] if len(turn) > 2 else {})), t + datetime.timedelta(minutes=i)))
    more = [("unknown", message("user", "q")), ("garbage", "no json"), ("array", '[{"role":"user","content":"x"}]'), ("cut", '{"role":"user","content":"x'), ("null", None), (None, message("user", "q"))]
    rows += [(100 + i, th, m, t) for i, (th, m) in enumerate(more)]
    rows += [(200, "ok", message("user", "q"), t), (1, "ok", message("user", "q"), t)]  # stored again, and repeated
    return rows


def test_verdicts(spark):
    m = spark.createDataFrame([(*r, "x") for r in conversation_rows()], "id bigint, thread_id string, message string, created_at timestamp, role string")
    th = spark.createDataFrame([(k,) for k in [*CASES, "silent", "silent", "garbage", "array", "cut", "null"]] + [(None,)], "id string")
    got = {r["thread_id"]: r["reason"] for r in conversations.thread_verdicts(m, th).collect()}
    assert {k: v for k, v in got.items() if v} == EXPECTED
    c = conversations.conversations(m, th).collect()
    assert {r["thread_id"] for r in c} == {"ok", "ok_case", "tool_ok", "synthetic"}
    tool = {r["id"]: r for r in c if r["thread_id"] == "tool_ok"}
    assert sum(r["parent_id"] is None for r in tool.values()) == 1 and len({r["root_id"] for r in tool.values()}) == 1
    empty = m.where("false")
    assert conversations.thread_verdicts(empty, th.where("false")).count() == 0
    assert {r["reason"] for r in conversations.thread_verdicts(empty, th).collect()} == {"empty"}
    assert conversations.conversations(empty, th).count() == 0


def test_one_large_thread(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [(i, "big", message("user" if i % 2 == 0 else "assistant", f"text {i}"), t + datetime.timedelta(seconds=i // 2)) for i in range(4000)]
    th = spark.createDataFrame([("big",)], "id string")
    schema = "id bigint, thread_id string, message string, created_at timestamp"
    assert conversations.thread_verdicts(spark.createDataFrame(rows, schema), th).first()["reason"] is None
    rows[2001] = (2001, "big", message("assistant", " "), rows[2001][3])
    assert conversations.thread_verdicts(spark.createDataFrame(rows, schema), th).first()["reason"] == "no_reply"


def test_page_numbers():
    body = ["some text of a full line that is long enough", "and it goes on without any end in sight now"] * 4
    lines = [*body, "12", *body, "88", *body, "13", *body, "14"]
    assert [lines[i] for i in sorted(pages.page_numbers(lines))] == ["12", "13", "14"]
    lines = [*body, "- 3 -", *body, "xii", *body, "Page 4 of 9", *body, "xiii"]
    assert len(pages.page_numbers(lines)) == 4
    assert pages.page_numbers([]) == set() and pages.page_numbers(["x"]) == set()


def test_running_lines():
    body = ["some text of a full line that is long enough", "and it goes on without any end in sight now,", "cases."] * 3
    lines = ["Tide table guide (Vanth)    3", *body, "Krexa copy, rev. 4", "\fTidc table guide (Vanth) 4", *body, "Krexa c0py, rev. 4"]
    got = pages.running_lines(lines, "Tide table guide (Vanth)", set())
    assert [lines[i] for i in sorted(got)] == [lines[0], "Krexa copy, rev. 4", "\fTidc table guide (Vanth) 4", "Krexa c0py, rev. 4"]
    assert pages.running_lines(lines, None, set()) == got


def test_readings():
    assert "timetable" in ocr.readings("tirnetable") and "about" in ocr.readings("@bovt") and ocr.readings("mmm") is not None
    best = ocr.decode(["the", "ta6le"], {1: [(-20.0, "ta6le", -1, -19.9, 0.0), (-9.0, "table", 2, -3.0, 5.0)]}, {("the", "table"): (5, 5)}, 100.0)
    assert best == [("the", -1), ("table", 2)]


CLEAN = "The table lists every mooring line and the count of the harbour. Nobody may cancel a stand-alone weather feed before the audit. Payroll will return the water tank. "


def scanned_records():
    page = ["The tab1e lists every mooring line and the count of the har-", "bour. Nobody may cancel a stand-", "alone weather feed before the audit. Payroll will return", "the vvater tank. The table lists every mooring line and the"]
    text = "\n".join(["Harbour notes", *page, "- 1 -", "\fHarbour notes", *page[::-1], "- 2 -"])
    return [("s", "Harbour notes", "a.pdf", '{"ocr": true}', text)] + [(f"c{i}", "t", "a.txt", '{"format": "txt"}', CLEAN * 5) for i in range(20)] + [("n", None, None, None, None), ("b", None, "x.pdf", "no json", " "), ("e", None, None, '{"ocr": true}', "")]


def test_scanned_pages(spark):
    df = spark.createDataFrame([(*r, None, 1) for r in scanned_records()] + [(*scanned_records()[0], None, 1)], "id string, title string, source string, metadata string, content string, received_at timestamp, kind int")
    got = {(r["line_no"], r["kind"]) for r in ocr.noisy_lines(df).collect()}
    assert {(1, "running"), (7, "running"), (6, "page_number"), (12, "page_number"), (2, "hyphen"), (2, "misread"), (5, "misread")} <= got
    assert (3, "hyphen") not in got and (4, "misread") not in got
    text = ocr.repaired(df).first()["content"]
    assert "the harbour. Nobody may cancel a stand-alone weather feed" in text and "water tank" in text and "Harbour notes" not in text and "- 1 -" not in text
    assert ocr.noisy_lines(df.where("false")).count() == 0 and ocr.repaired(df.where("id <> 's'")).count() == 0


def test_known_words_are_doubted_by_their_neighbours():
    """A word that is one, but stands where another is far likelier; and the same word where it belongs."""
    options = {1: [(-6.0, "bare", -1, -5.98, 300.0), (-7.5, "hare", 0, -4.0, 3000.0)]}
    assert ocr.decode(["the", "bare", "ran"], options, {("the", "hare"): (400, 3000), ("hare", "ran"): (50, 60)}, 1e5)[1] == ("hare", 0)
    assert ocr.decode(["a", "bare", "wall"], options, {("a", "bare"): (40, 300), ("bare", "wall"): (20, 60)}, 1e5)[1] == ("bare", -1)


def pii_texts():
    out = []
    for i, (g, f) in enumerate([("Marnick", "Glouse"), ("Dagny", "Keno"), ("Osric", "Tavel"), ("Brisa", "Feris")] * 6):
        out += [f"Samples go to us, attention Ms. {g} {f}ley. Fine.", f"Minutes taken by {g} {f}berg. Fine.", f"ask {g} {f}sen about it, +44 7700 90012{i % 10}", f"Approved by {g} {f}ova, identity number QQ12345{i % 10}C. Ok."]
    return out


@pytest.mark.parametrize("entries", [300_000, 0])
def test_mentions(spark, monkeypatch, entries):
    monkeypatch.setattr(pii, "BROADCAST_ENTRIES", entries)
    a = [(f"d{i}", t, None) for i, t in enumerate(pii_texts())]
    tests = {
        "t1": ("ask dagny glousley about it, 020 7946 0750", [("person", 4), ("phone", 29)]),
        "t2": ("Minutes taken by Zyra Unknownley.", [("person", 17)]),
        "t3": ("Send it to a.b+c@mail.tide.example or x_1 [at] post [dot] tide [dot] org now", [("email", 11), ("email", 38)]),
        "t4": ("We moved to 72b Candlewick Rd, Teska X5 1ZZ last week", [("address", 12)]),
        "t5": ("geht an Hafenplatz 135, 05680 Tae. Calle del Telar 45, 3º B, Sto. 80 bis, rue des Glycines, Brae", [("address", 8), ("address", 35), ("address", 66)]),
        "t6": ("Order number 555-010-22-A is open. The build 10.4.0.17 was tagged at 2026-03-14 09:26. Write @desk.", []),
        "t7": ("Minutes taken by Keno, Dagny. Call (332) 555-0132", [("person", 17), ("phone", 35)]),
        "t8": ("Nobody speaks of MARNICK.KENO@POST.TIDE.TEST here", [("email", 17)]),
        "t9": ("Minutes taken by M. Feris. Dr. Osric B. Tavel came.", [("person", 17), ("person", 31)]),
        "t10": ("", []),
    }
    a += [(k, v[0], None) for k, v in tests.items()] + [("n", None, None), (None, "ask Dagny Keno about it", None), ("long", "x " * 50_000 + "ask Dagny Keno about it", None)]
    i = spark.createDataFrame(a, "id string, content string, kind string")
    m = spark.createDataFrame([(1, message("user", "I am Dagny Keno")), (1, message("user", "I am Dagny Keno")), (2, "broken"), (3, None), (4, message("user", None)), (5, "[1]"), (None, "x")], "id bigint, message string")
    got: dict = {}
    for r in pii.mentions(i, m).collect():
        got.setdefault(r["record_id"], []).append((r["kind"], r["start_at"]))
    for k, (_, exp) in tests.items():
        assert sorted(got.get(k, []), key=lambda x: x[1]) == exp, k
    assert got["long"] == [("person", 100_004)] and got["1"] == [("person", 5)]
    red = {(r["field"], r["record_id"]): r["text"] for r in pii.redacted(i, m).collect()}
    assert red["ingest_documents.content", "t4"] == "We moved to [ADDRESS] last week" and red["messages.message", "1"] == "I am [PERSON]" and red["messages.message", "2"] is None
    assert pii.mentions(i.where("false"), m.where("false")).count() == 0


def test_two_models_in_one_session(spark):
    """A worker that is used again must not answer with the model before."""
    m = spark.createDataFrame([], "id bigint, message string")
    names = {"Dagny": pii_texts(), "Zorvex": [t.replace("Dagny", "Zorvex") for t in pii_texts()]}
    for k in range(6):
        given = list(names)[k % 2]
        rows = [(f"d{i}", t) for i, t in enumerate(names[given])] + [("q", "then dagny glousley left"), ("r", "ask zorvex glousley about it"), ("s", "ask dagny glousley about it")]
        got = {r["record_id"] for r in pii.mentions(spark.createDataFrame(rows, "id string, content string"), m).collect()}
        assert ("s" in got, "r" in got) == (given == "Dagny", given == "Zorvex")


def test_long_local_parts():
    assert list(pii.emails("to " + "a.b" * 100 + "@post.tide.test now")) == [(3, 318)] and list(pii.emails("-_x @ y.z")) == [(2, 9)] and not list(pii.emails("x. @y.z"))


def test_reply_links_of_any_age(spark):
    """Every earlier message may be the parent: against a walk over the whole thread, with gaps of minutes to weeks."""
    import datetime as dt
    import random

    rng, t = random.Random(5), dt.datetime(2024, 1, 1)
    vocabulary = ["alpha", "bravo", "delta", "gamma", "kappa", "omega", "sigma", "theta"]
    rows = []
    for i in range(240):
        t += dt.timedelta(seconds=rng.choice([20, 300, 3_660, 8_000, 90_000, 900_000]))
        role = rng.choice(["user", "assistant", "tool"])
        calls = [f"c{i}"] if role == "assistant" else []
        call = f"c{rng.randrange(max(1, i))}" if role == "tool" and i % 3 else None
        rows.append((f"t{i % 2}", i, t, role, " ".join(rng.sample(vocabulary, rng.randrange(5))), call, calls))
    want = {}
    for n, (thread, id_, at, role, content, call, _) in enumerate(rows):
        best = (0.0, None)
        for thread2, id2, at2, role2, content2, _, calls2 in reversed(rows[:n]):
            if thread2 != thread:
                continue
            words = set(content.split())
            score = 0.5 ** ((at - at2).total_seconds() / 600) + len(words & set(content2.split())) / (1 + len(words))
            if call is not None and call in calls2:
                score += 4
            elif (role == "user") == (role2 == "user"):
                score -= 0.75 if role == "user" else 0.25
            if score > best[0] or best[1] is None and (role == "user") != (role2 == "user"):
                best = (score, id2)
        want[id_] = best[1]
    df = spark.createDataFrame(rows, "thread_id string, id bigint, created_at timestamp, role string, content string, call string, calls array<string>")
    for span in (3_600, 86_400):
        assert {r["id"]: r["parent_id"] for r in conversations.reply_links(df, span).collect()} == want


def test_digits_for_letters_are_read(spark):
    """Words that look like codes are misread words if a known word may be meant, and codes otherwise."""
    import datetime as dt

    clean = "The costs of the contract and the form were moved by a plant. Users of the old job inside may pay again. Part a19x is kept.\n"
    page = "The c0sts of the c0ntract and the f0rm\nwere m0ved by a p1ant of part a19x\nu5ers of the old j0b 1n51de may pay\na9ain and part 7q45 is kept here."
    rows = [(f"c{i}", "t", "web", "{}", clean * 40, dt.datetime(2024, 1, 1)) for i in range(3)] + [("s", "t", "a.pdf", '{"ocr": true}', page, dt.datetime(2024, 1, 1))]
    assert [w for _, w in ocr.tokens("c0sts 7q45 https://x.y/1")] == ["c0sts"]
    assert "inside" in ocr.readings("1n51de") and "costs" in ocr.readings("c0sts")
    df = spark.createDataFrame(rows, "id string, title string, source string, metadata string, content string, received_at timestamp")
    _, changes, _ = ocr.judged_lines(df)
    got = {(c["word"], c["meant"]) for r in changes.collect() for c in r["changes"]}
    assert {("c0sts", "costs"), ("c0ntract", "contract"), ("f0rm", "form"), ("m0ved", "moved"), ("p1ant", "plant"), ("u5ers", "users"), ("j0b", "job"), ("a9ain", "again")} <= got
    assert not {w for w, _ in got} & {"a19x", "7q45"}


def test_no_cut_inside_a_run_that_fits():
    text = "word " * 60 + "x" * 700 + " word" * 60
    at = splitting.cuts(text, 1200, 150)
    assert len(text) == 1300 and all(not text[a - 1] + text[a] == "xx" for a in at[1:-1])
