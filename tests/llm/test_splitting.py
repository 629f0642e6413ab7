import pytest

from sestante.llm.splitting import split_items

SCHEMA = "id string, text string, section string, piece string, ends string"


def cut_plainly(text, limit, overlap, title):
    """The same rule, stated without regular expressions: ``(start, body)`` of each piece, and the finest cut."""
    room = max(1, limit - overlap - (len(title) + 1 if title else 0))
    out, at, finest = [], 0, 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return out, ["line", "sentence", "word", "hard"][finest]
        rest = text[at:]
        here = lambda i: rest[i : i + 1]
        rules = [
            lambda i: i == len(rest) or rest[i - 1] == "\n" or here(i) == "\n",
            lambda i: rest[i - 1] in ".!?" and here(i).isspace(),
            lambda i: here(i).isspace(),
        ]
        best = next(((n, k) for k, rule in enumerate(rules) for most in (room, limit) for n in [next((i for i in range(min(most, len(rest)), 0, -1) if rule(i)), 0)] if n), None)
        n, k = best or (min(room, len(rest)), 3)
        finest = max(finest, k)
        out.append((at, rest[:n]))
        at += n


CASES = [
    "x" * 950,
    "parola " * 200,
    "Una frase breve. " * 80,
    "\n".join("riga numero %d con testo." % i for i in range(90)),
    "Titolo\n" + "lunga frase senza fine " * 60 + ". Fine.\n" + "y" * 400,
    "é" * 300 + " 😀 " * 200,
    "\n".join("w" * n + "." for n in (262, 280, 299, 300, 12, 290)),
    "  Inizio. " + "f" * 297 + ". " + "g" * 300 + ".  \n\n" + "h" * 40 + "   ",
]


def test_pieces_equal_the_plain_rule(spark):
    rows = [(str(n), t, s, None, None) for n, t in enumerate(CASES) for s in (None, "Orari > Sala")]
    rows = [(f"{i}-{s}", t, s, None, None) for i, t, s, _, _ in rows]
    got = split_items(spark.createDataFrame(rows, SCHEMA), limit=300, overlap=40).collect()
    for i, text, section, _, _ in rows:
        mine = sorted((r for r in got if r.chunk_id == i), key=lambda r: r.piece_no)
        want, finest = cut_plainly(text, 300, 40, section or "")
        assert [(r.start, r.piece[len(r.piece) - r.body_chars :]) for r in mine] == want
        assert {r.finest_cut for r in mine} == {finest}
        assert "".join("".join(b for _, b in want).split()) == "".join(text.split())
        assert all(len(r.piece) <= 300 for r in mine)
        for before, r in zip(mine, mine[1:]):
            head = f"{section}\n" if section and len(section) + 1 + r.body_chars <= 300 else ""
            lap = r.piece[len(head) : len(r.piece) - r.body_chars]
            assert r.piece.startswith(head) and before.piece.rstrip().endswith(lap.rstrip()) and len(lap) <= 40


@pytest.mark.parametrize("size", [1247, 1251, 1300, 1399, 1400])
def test_lines_within_the_limit_stay_whole(spark, size):
    text = "\n".join(["p" * (size - 1) + "."] * 3)
    got = split_items(spark.createDataFrame([("a", text, "Titolo", None, None)], SCHEMA), limit=1400, overlap=150).collect()
    assert [r.body_chars for r in sorted(got, key=lambda r: r.piece_no)] in ([size] * 3, [size + 1, size + 1, size])
    assert {r.finest_cut for r in got} == {"line"} and all(len(r.piece) <= 1400 for r in got)


def test_finest_cut(spark):
    rows = [("line", "a b\n" * 90), ("sentence", "Uno due. " * 40), ("word", "uno " * 90), ("hard", "z" * 301), (None, "w" * 400)]
    got = split_items(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA), limit=300, overlap=20)
    assert {(r.chunk_id, r.finest_cut) for r in got.collect()} == {(i, i or "hard") for i, _ in rows}


def test_nulls_repeats_short_and_empty(spark):
    df = spark.createDataFrame([("a", None, None, "p", "e"), ("b", "", " ", "p", "e"), ("c", "k" * 300, None, "p", "e"), ("d", "k" * 301, "", "p", "e"), ("d", "k" * 301, "", "p", "e")], SCHEMA)
    got = split_items(df, limit=300, overlap=50).collect()
    assert {r.chunk_id for r in got} == {"d"} and len(got) == 2
    assert split_items(df.where("false")).count() == 0


def test_very_long_text(spark):
    text = ("abc " * 100 + "\n") * 500
    got = split_items(spark.createDataFrame([("a", text, None, None, None)], SCHEMA), limit=1400, overlap=150).collect()
    assert sum(r.body_chars for r in got) >= len(text.replace(" ", "").replace("\n", "")) and {r.n_pieces for r in got} == {len(got)}
