import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, level int, name string, part int, label string, score double, rate double, mix_copy int, gone_id long, mark_sha string, near_key long, fp binary, sid long, rank int, sequence_id long"
#: Columns past the documents' own clash with names that the operators use.
PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


def make_rows():
    rng = random.Random(7)
    words = {"en": "the of and that with from tion ing have not".split(), "de": "der die und nicht ein sch keit ung über zu".split(),
             "fr": "le la des que dans être élève eau pour avec".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        rows.append([i, text(lang, rng.randint(1, 160)), lang, f"src{rng.randint(0, 6)}"])
    for i in range(240, 330):  # a third of one source and copies of one text
        rows.append([i, rows[3][1] if i % 2 else rows[3][1].upper(), rows[3][2], "src0"])
    rows[5][1] = None
    rows[6][1] = ""
    rows[7][1] = " \n\t "
    rows[8][1] = "12 345 ... !!"
    rows[9][1] = text("en", 30_000)  # many blocks, many pieces
    rows[10][1] = rows[9][1] + "x"
    rows[11][1] = "日本語 テキスト 😀   a\r\nb  c <|endoftext|> İß"
    rows[12][2] = None
    rows[13][3] = None
    rows[14][3] = None
    words9 = rows[20][1].split()
    rows[21][1] = " ".join(words9)
    rows.append(list(rows[30]))  # a repeated row
    rows.append([31, "another text of an id that is there twice", "en", "src1"])
    rows.append([None, "no id", "en", "src1"])
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(d, t, l, s, len(t or ""), 1, 2, "n", 3, "l", 0.5, 0.1, 1, 2, "m", 3, b"f", 4, 5, 6) for d, t, l, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
