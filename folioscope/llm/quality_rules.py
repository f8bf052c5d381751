"""Rules learned by `python -m folioscope.llm.train_quality`; written by it, not by hand."""

#: Share of held-out labels that the rules give: 0.9627
RULES = [
    [('listed_share', '>=', 0.76978)],
    [('words_per_stop', '>=', 43.11), ('n_words', '>=', 84.0)],
    [('words_per_stop', '>=', 32.0), ('comma_share', '>=', 0.1748)],
    [('distinct_share', '<=', 0.33337)],
    [('words_per_line', '<=', 5.2276), ('n_words', '>=', 21.86)],
    [('words_per_stop', '>=', 40.16), ('mean_word_length', '<=', 4.202)],
    [('comma_share', '>=', 0.48411)],
    [('words_per_stop', '>=', 59.0), ('digit_share', '>=', 0.0041583)],
    [('words_per_stop', '>=', 27.0), ('mean_word_length', '<=', 3.504)],
    [('miscoded_share', '>=', 0.2661)],
    [('symbol_share', '>=', 0.1094)],
    [('words_per_stop', '>=', 40.35), ('mean_word_length', '>=', 5.2554)],
    [('words_per_stop', '>=', 25.0), ('distinct_share', '<=', 0.98641)],
]
