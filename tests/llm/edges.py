#: Nulls, empty and blank texts, a very long one, one long word, odd characters, and repeats.
EDGES = [None, "", " \n\t ", "word", "word", "a b c d e f g h i j k l", "x" * 20000, "lorem ipsum dolor sit amet " * 3000, "\x00 é 😀 　 \u2028 ▁ ﬁ", "A-b.c@d.e +1 (988) 555-2485 4041894974608795 1.2.3.4"]
