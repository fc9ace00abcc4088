"""Small document tables with every odd case, and brute-force versions of the operators."""

import random
import re

WORDS = [f"w{i}" for i in range(40)] + ["é", "naïve", "straße", "日本"]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def documents(seed=3):
    """Rows (doc_id, text, lang, source, n_chars): nulls, empties, copies, near copies, shared passages, a very long text, repeated ids."""
    draw = random.Random(seed)
    passage, passage2 = prose(draw, 70), prose(draw, 55)
    texts = [None, "", "  \n\t ", "one", "Two Words", prose(draw, 9), prose(draw, 49), prose(draw, 50), passage, passage]
    texts += [f"{prose(draw, 30)}\n{passage}\n{prose(draw, 25)}" for _ in range(5)]
    texts += [f"{passage2} {prose(draw, 12)} {passage2}", f"{prose(draw, 8)} {passage2}", prose(draw, 400) + " " + passage + " " + prose(draw, 2600)]
    base = prose(draw, 120)
    for k in range(6):
        ws = base.split()
        ws[draw.randrange(120)] = f"changed{k}"
        texts.append(" ".join(ws))
    texts += [base, base, prose(draw, 80).upper(), "a  b c d\x0be", "x" * 5000, "!? -- ??", "ÀÉ Straße \x1c ẞ"]
    rows = [(i, t, "en", "src0" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(8, passage, "en", "src1", len(passage)), (None, passage, None, "src1", 5), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def white_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
