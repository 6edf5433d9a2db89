"""Random small corpora with copies, near copies, shared passages and odd texts."""

import random


def corpus(seed: int, n: int = 60, vocab: int = 40, odd: bool = True) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(vocab)) * r.randrange(1, 3)
    passages = [" ".join(word() for _ in range(r.randrange(5, 60))) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.35 and texts:
            words = (r.choice(texts) or "").split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            parts = [" ".join(word() for _ in range(r.randrange(0, 50)))]
            if r.random() < 0.5:
                parts.insert(r.randrange(2), r.choice(passages))
            texts.append(r.choice([" ", "\n", "  \t"]).join(parts))
    if odd:
        texts += [None, "", " \n\t ", "x", "ünï cödé " * 30, "a " * 400, "ab" * 900, "\x00 \x0b\x0c nul  double"]
    return [(i, t, "en", "s", len(t) if t is not None else 0) for i, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
