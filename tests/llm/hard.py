"""Hard rows: nulls, empty and very long texts, copies, ties, repeated rows, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, count int, fp string, shard int"
WORDS = "the quick brown fox jumps over a lazy dog while rain falls on old stone walls and nobody minds at all today".split()


def text(i, n=40):
    return " ".join(WORDS[(i * 7 + j * (i % 5 + 1) + j * j) % len(WORDS)] + str((i * j) % 3) for j in range(n))


def hard_rows():
    """Nulls, empty, blank and very long texts, copies, near copies, odd characters, repeated rows, a null id."""
    base = text(3, 120)
    texts = [
        "", None, " \n\t ", base, base, base.replace("fox0", "cat9", 1), text(4), text(4) + "\n", "one", "Two words", "x" * 30_000, "ab " * 20_000, "naïve façade Ångström İstanbul é",
        "a  b\n\nc \t d e f\x1cg", "before <|endoftext|> and<|startoftext|>after", "日本語の文章です。これは長い文です。", "12345 67 8,9.0!? ...", "don't we'll I'm they've", "\x00\x01 zero \x01a", "A B C D", "a b c d", "ends with blank ", " starts with blank",
        text(6) * 30, text(6) * 30, "zebra",
    ]
    rows = [(i, t, "en" if t else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "k", 1, "f", 2) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, "en", "s0", 5, "k", 1, "f", 2), (None, "lost", None, None, 4, None, None, None, None)]
