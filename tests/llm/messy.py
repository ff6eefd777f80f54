"""Small tables with every awkward case, shared by the tests."""

from formloom.session import local_table

WORDS = "the quick brown fox jumps over a lazy dog while nobody watches from behind the old wooden fence".split()
LONG = " ".join(WORDS[i % len(WORDS)] + str(i % 977) for i in range(30_000))
ODD = "</s>[INST] Ünïcode ΑΣ \x1c 中文 <|endoftext|> it's 12%"

ROWS = [
    (1, "The quick  brown fox", "en", "s"),
    (2, "The quick brown\tfox", "en", None),
    (3, None, "en", "s"),
    (4, "", None, "s"),
    (5, " \n\t ", "fr", "s"),
    (6, LONG, "en", "s"),
    (7, LONG, "en", "s"),
    (8, ODD, "de", "s"),
    (8, ODD, "de", "s"),
    (None, "an id is missing here", "en", "s"),
    (9, " ".join(WORDS * 4), "en", "s"),
    (10, " ".join(WORDS * 4 + ["more"]), "en", "s"),
    (11, "two words", "es", "s"),
    (12, "Two  WORDS", "es", "s"),
    (13, "123 456 !!", "en", "s"),
]
CLASHING = ["row", "ids", "given", "made", "recipe", "kept", "id", "n", "g", "shard", "lang_pred", "score", "order", "component"]


def documents(spark, rows=ROWS):
    """Documents with extra columns whose names operators use themselves."""
    extra = ", ".join(f"`{name}` string" for name in CLASHING)
    data = [(*row, len(row[1] or ""), *["x"] * len(CLASHING)) for row in rows]
    return local_table(spark, data, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
