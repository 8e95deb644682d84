TEXTS = [
    "", "\n", " a  b\n\nc ", "x|y | < <|endoftext|> z", "It's DON'T 123. a,b.", "́a  b", "Σας ΟΔΟΣ. É.", "\r\t tab",
    "Word word WORD word, word. (word) word.. w,", "é é  wide space", "1234 5a6 a5b", "Straße. İstanbul, ǅ", "Ķbİ, aİ. \ufb1d. שּׁ, ŉ. ſo, ª. Ŀ. éÉ, ÀÉ.",
]
