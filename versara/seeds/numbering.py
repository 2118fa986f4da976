"""Psalm numbering between the Greek and the Hebrew division. Fixed values."""

#: Greek psalms whose superscription takes no verse of its own though the Hebrew psalm has one, and those in
#: which it takes two.
NO_TITLE_VERSE = """
13 14 15 16 22 23 24 25 26 27 28 31 34 36 49 65 72 73 77 78 81 85 86 89 97 100 102 109 119 120
121 122 123 124 125 126 127 128 130 131 132 133 137 138 140 142 143 144
"""
TWO_TITLE_VERSES = "50 51 53 59"

#: Why a Greek verse has no counterpart that could be shown alone.
JOINED = "one Greek verse covers several Hebrew verses"
REDIVIDED = "verses are divided in another way than in the Hebrew psalm"
GREEK_ONLY = "only the Greek psalm has this superscription"

#: Greek psalm: its runs. A run is (Hebrew psalm, first English verse, verses, title verses) or
#: (verses, reason); None stands for what the Hebrew psalm's own table says.
IRREGULAR = {
    9: [(9, 1, None, None), (10, 1, None, None)],
    12: [(13, 1, 1, 0), (13, 2, 1, 0), (13, 2, 1, 0), (13, 3, 1, 0), (13, 4, 1, 0), (1, JOINED)],
    43: [(44, 1, 20, 1), (1, JOINED), (44, 23, 4, 0)],
    52: [(53, 1, 1, 0), (53, 1, 1, 0), (53, 2, 5, 0)],
    55: [(56, 1, 10, 1), (2, REDIVIDED)],
    71: [(72, 1, 0, 1), (1, JOINED), (72, 3, 18, 0)],
    99: [(1, GREEK_ONLY), (1, JOINED), (100, 3, 3, 0)],
    108: [(109, 1, 0, 1), (1, JOINED), (109, 3, 29, 0)],
    113: [(114, 1, None, None), (115, 1, None, None)],
    114: [(116, 1, 9, None)],
    115: [(116, 10, None, 0)],
    129: [(130, 1, 3, 0), (4, REDIVIDED), (130, 8, 1, 0)],
    145: [(1, GREEK_ONLY), (1, JOINED), (146, 3, 8, 0)],
    146: [(147, 1, 11, None)],
    147: [(147, 12, None, 0)],
}

#: (first Greek psalm, last, what to add for the Hebrew one), where the two run side by side.
REGULAR = [(1, 8, 0), (10, 112, 1), (116, 145, 1), (148, 150, 0)]
#: (first Hebrew psalm, last, Greek psalm or None for an offset, offset), for display.
TO_GREEK = [(1, 8, None, 0), (9, 10, 9, 0), (11, 113, None, -1), (114, 115, 113, 0), (116, 116, 114, 0), (117, 146, None, -1), (147, 147, 146, 0), (148, 150, None, 0)]

#: Verses of the 150 psalms in the English division, and the psalms with a superscription.
ENGLISH_VERSES = """
6 12 8 8 12 10 17 9 20 18 7 8 6 7 5 11 15 50 14 9 13 31 6 10 22 12 14 9 11 12
24 11 22 22 28 12 40 22 13 17 13 11 5 26 17 11 9 14 20 23 19 9 6 7 23 13 11 11 17 12
8 12 11 10 13 20 7 35 36 5 24 20 28 23 10 12 20 72 13 19 16 8 18 12 13 17 7 18 52 17
16 15 5 23 11 13 12 9 9 5 8 28 22 35 45 48 43 13 31 7 10 10 9 8 18 19 2 29 176 7
8 9 4 8 5 6 5 6 8 8 3 18 3 3 21 26 9 8 24 13 10 7 12 15 21 10 20 14 9 6
"""
TITLED = """
3 4 5 6 7 8 9 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 34 35 36 37 38 39 40 41 42 44
45 46 47 48 49 50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 69 70 72 73 74 75 76 77 78 79 80 81 82
83 84 85 86 87 88 89 90 92 98 100 101 102 103 108 109 110 120 121 122 123 124 125 126 127 128 129 130 131 132
133 134 138 139 140 141 142 143 144 145
"""
