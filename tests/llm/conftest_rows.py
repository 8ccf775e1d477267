"""Rows that every operator must live with."""

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a"), (None, None), (5, "word " * 30_000), (6, "é" * 5000),
    (7, "9" * 20_000), (8, "a@" * 8000), (9, "1.1." * 8000), (10, "+1" + "(" * 20_000), (11, "x\x00y\u0085z \U0001f600"),
]
