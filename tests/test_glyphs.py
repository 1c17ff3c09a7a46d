import random

from pyspark.sql import functions as F

from docsql.sources import files, glyphs


def test_markdown(spark):
    rows, seq = [], 0

    def line(page, y, text, size=10.0, x=50.0):
        nonlocal seq
        for word in text.split(" "):
            rows.append(("d", page, seq, x, y, len(word) * 5.0, size, word))
            seq += 1
            x += len(word) * 5.0 + 3

    for page in range(1, 5):
        line(page, 800.0, "Yearly report")
        line(page, 790.0, ["", "Alpha", "Beta", "Gamma", "Delta"][page] + " opens here.")
        line(page, 780.0, f"Part {page}x", 16.0)
        line(page, 760.0, "A first line of text that was bro-")
        line(page, 748.0, "ken at its end.")
        line(page, 700.0, "• a point")
        rows.append(("d", page, seq, 50.0, 680.0, 20.0, 10.0, "one"))
        rows.append(("d", page, seq + 1, 200.0, 680.0, 20.0, 10.0, "two"))
        seq += 2
        line(page, 660.0, "More words here stand.")
        line(page, 20.0, f"Page {page} of 4")
    df = spark.createDataFrame(rows, "doc string, page int, seq int, x double, y double, width double, size double, text string")
    text = glyphs.markdown(df).first()["text"]
    assert text.count("# Part") == 4 and "bro" not in text.replace("broken", "") and "broken at its end." in text
    assert "- a point" in text and "| one | two |" in text and "Yearly" not in text and "of 4" not in text
    assert glyphs.markdown(df.where("false")).count() == 0


def test_one_document_reads_as_in_a_table(spark):
    rng, docs = random.Random(5), {}
    words = ["alpha", "Beta", "", " ", "x-", "the", "Über-", "ende.", "a\tb", "|", "-", "•", "3.", "(4)", "why?", "é ", None]
    for d in range(150):
        runs = docs[f"d{d}"] = []
        for page in range(1, rng.randint(1, 6) + 1):
            y = 800.0
            for n in range(rng.randint(0, 9)):
                size, x = rng.choice([9.0, 10.0, 10.0, 10.0, 10.3, 14.0, 18.0]), rng.choice([50.0, 50.0, 62.0])
                texts = rng.choice([["Yearly", "list", str(page)], ["Page", str(page), "of", "4"], ["•", "point"], [str(page)], *[[rng.choice(words) for _ in range(rng.randint(1, 8))] for _ in range(5)]])
                for t in texts:
                    runs.append({"page": page, "seq": len(runs), "x": x, "y": y + rng.choice([0.0, 0.0, 0.0, 2.0]), "width": 5.0 * len(t or ""), "size": size, "text": t})
                    x += 5.0 * len(t or "") + rng.choice([0.5, 3.0, 3.0, 3.0, 30.0])
                y -= rng.choice([12.0, 12.0, 12.0, 13.0, 24.0, 40.0, -300.0])
        rng.shuffle(runs)
    names = ["page", "seq", "x", "y", "width", "size", "text"]
    df = spark.createDataFrame([(d, *[r[c] for c in names]) for d, runs in docs.items() for r in runs], "doc string, page int, seq int, x double, y double, width double, size double, text string")
    told = {r["doc"]: r["text"] for r in glyphs.markdown(df).collect()}
    assert len(told) > 100 and {d: t for d, runs in docs.items() if (t := glyphs.markdown_of(runs))} == told


def test_pdfs_are_read_where_they_lie(spark):
    """A file's text needs no other file: nothing is exchanged or written, and one without text is a document like an empty file."""

    def decode(data):
        if data.endswith(b"broken"):
            raise ValueError("no pages")
        return [{"page": 1, "seq": i, "x": 50.0 + 40 * i, "y": 800.0, "width": 35.0, "size": 10.0, "text": t} for i, t in enumerate(data.decode().split()[1:])]

    made = spark.createDataFrame([(f"/in/{n}.pdf", b"%PDF-1.7 " + t) for n, t in (("a", b"one two"), ("b", b""), ("c", b"broken"))], "path string, content binary").coalesce(1)
    r = files.load_binaries(made, None, decode)
    assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["path"], x["format"], x["kind"], x["content"], x["error"]) for x in r.collect()) == [("/in/a.pdf", "pdf", "document", "one two", None), ("/in/b.pdf", "pdf", "document", "", None), ("/in/c.pdf", "pdf", "error", None, "ValueError: no pages")]


def test_event_data(spark):
    body = "event: x\ndata: one\ndata: two\n\n: note\n\ndata:three\r\n\r\n"
    assert spark.createDataFrame([(body,)], "b string").select(glyphs.event_data(F.col("b")).alias("d")).first()["d"] == ["one\ntwo", "three"]
