"""Documents with every odd case."""

#: Nulls, empty and blank texts, ties, repeated rows, control characters, long words.
LONG = " ".join(f"word{i} sits here" for i in range(400))
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r ", "de", None),
    (4, LONG, "en", "b"),
    (5, LONG, "en", "b"),
    (6, LONG.replace("word7 ", "other "), None, "b"),
    (6, LONG.replace("word7 ", "other "), None, "b"),
    (7, "one two three", "en", "c"),
    (8, "ONE two\tthree", "en", "c"),
    (None, "one two three", "en", "c"),
    (9, "é ü 😀 日本語 one\nline\nline\nline", "fr", "c"),
    (10, "x" * 5000, "en", "d"),
    (11, "spam spam spam " * 200, "en", "d"),
    (12, "token: abcdefghijkl1234 and password=short secret : 'Zm9vYmFyYmF6cXV4'", "en", "a"),
    (13, "<|endoftext|> don't <|im_end|> ~0 123   ", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
