"""Documents with every odd case."""

LONG = " ".join(f"w{i}x{i * 7 % 13}" for i in range(9_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def documents():
    """Null ids, texts and sources, empty and blank texts, a very long one, copies, near copies, repeated rows, a shared passage."""
    base = [f"token{i % 37} word{i} thing{i % 11}" for i in range(40)]
    text = " ".join(base)
    near = " ".join(base[:39] + ["token other ending"])
    rows = [
        (1, text, "en", "a", 5), (2, text, "en", "b", 5), (3, near, "en", "b", 5), (4, text.upper(), "de", None, 5), (5, None, None, "a", None), (6, "", "en", "a", 0),
        (7, " \t\n ", "en", "c", 4), (8, LONG, "en", "a", 9), (9, "two words", "en", "c", 9), (9, "two words", "en", "c", 9), (10, "Two\tWORDS", "fr", "c", 9),
        (11, f"alpha beta {PASSAGE} gamma", "en", "a", 1), (12, f"{PASSAGE} delta", "en", "b", 1), (13, f"zeta\n{PASSAGE}", "en", "d", 1), (None, "no id at all here", "en", "a", 1), (None, None, None, None, None),
        (14, "éa ñ ü café 日本 語 x y", "es", "d", 3), (15, "it's isn't 's <|endoftext|> a.  b...\n\n c", "en", "d", 3),
    ]
    rows += [(100 + i, f"{'lorem ipsum dolor ' * (i % 5 + 1)}number {i}", "en", "a", i) for i in range(30)]
    rows += [(200 + i, "the very same copy of one short text", "en", "hot", i) for i in range(40)]
    return rows
