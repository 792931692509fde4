"""Chunks against a plain chunker that goes line by line and character by character, over the tables' documents and random ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakelore.operators import chunking as C
from lakelore.plans import queries
from lakelore.session import table


def count(text):
    n, word = 0, False
    for c in text:
        is_word = c.isalnum() or c == "_"
        n += (is_word and not word) or (not is_word and not c.isspace())
        word = is_word
    return n


def tail(text, n):
    if count(text) <= n:
        return text
    k = len(text)
    while k and count(text[k:]) < n:
        k -= 1
    while k and count(text[k - 1 :]) == count(text[k:]):  # the whole of its first word
        k -= 1
    return text[k:].lstrip()


def head(text, n):
    k = 0
    while k < len(text) and (count(text[: k + 1]) <= n):
        k += 1
    return text[:k].rstrip() if k < len(text) else text


def sentences(text):
    out, k = [], 0
    while k < len(text):
        a = k
        if text[k] in ".!?":
            while k < len(text) and text[k] in ".!?":
                k += 1
        else:
            while k < len(text) and text[k] not in ".!?":
                k += 1
            k += k < len(text)
        while k < len(text) and text[k].isspace():
            k += 1
        out.append(text[a:k])
    return out


def packed(parts, room, joint):
    out, group, used = [], [], 0
    for p in parts:
        if group and used + count(p) > room:
            out.append(joint.join(group))
            group, used = [], 0
        group.append(p)
        used += count(p)
    return out + [joint.join(group)] * bool(group)


def table_of(unit):
    lines = [x for x in unit.split("\n") if x.strip()]
    return len(lines) > 2 and all(x.strip()[0] == "|" for x in lines) and re.match(r"\s*\|?\s*:?---", lines[1]) is not None


def plain(title, markdown, size, overlap, most):
    stack, lines, found, code = [], [], [], False

    def close():
        body = "\n".join(lines).strip()
        if body:
            found.append(([t for _, t in stack], body))
        lines.clear()

    for line in (markdown or "").split("\n"):
        fence = line.strip()[:3] == "```"
        hit = None if code or fence else re.match(r"(#{1,6})\s+(.+?)\s*$", line)
        if hit:
            close()
            while stack and stack[-1][0] >= len(hit[1]):
                stack.pop()
            stack.append((len(hit[1]), hit[2]))
        else:
            lines.append(line)
        code ^= fence
    close()
    out = []
    for path, body in found or [([], (markdown or "").strip())]:
        if len([c for c in body if c.isalnum()]) < 3:
            continue
        top = "# " + " › ".join(path) + "\n\n" if path else ""
        if count(body) <= size:
            bodies = [body]
        else:
            units, unit, code = [], [], False
            for line in [*body.split("\n"), None]:
                fence = line is not None and line.strip()[:3] == "```"
                if line is None or not line.strip() and not code:
                    units += ["\n".join(unit).strip()] * bool("\n".join(unit).strip())
                    unit = []
                else:
                    unit.append(line)
                code ^= fence
            bodies, waiting = [], []
            for u in units:
                if count(u) <= size:
                    waiting.append(u)
                    continue
                bodies += packed(waiting, size, "\n\n")
                waiting = []
                if table_of(u):
                    a, b, *rest = [x for x in u.split("\n") if x.strip()]
                    bodies += [f"{a}\n{b}\n{g}" for g in packed(rest, size - count(f"{a}\n{b}"), "\n")]
                else:
                    run = []
                    for s in sentences(u):
                        if count(s) <= size:
                            run.append(s)
                        else:
                            bodies += packed(run, size, "")
                            run = []
                            bodies += [s[i : i + 4 * size] for i in range(0, len(s), 4 * size)]
                    bodies += packed(run, size, "")
            bodies += packed(waiting, size, "\n\n")
        for k, now in enumerate(bodies):
            text = top + (f"{tail(bodies[k - 1], overlap)}\n\n{now}" if k and overlap and not table_of(now) else now)
            if not text.strip():
                continue
            text = head(text, most)
            name, same = " ".join((title or "").split()), path and text.split("\n")[0] == "# " + " › ".join(path)
            if name and not (same and path[0].strip().lower() == name.lower()):
                text = head(f"# {name} › {' › '.join(path)}\n{text.split('\n', 1)[1] if '\n' in text else ''}" if same else f"# {name}\n\n{text}", most)
            out.append((text, path))
    return out


def _random(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta_2", "über", "x", "#", "-", "...", "Hm!", "why?", "| a | b |", "|---|---|", "| 1 | 2 |", "```", "# One", "## Two", "### Three three", "", "", "long" * 30, "A sentence. Another one! And"]
    lines = []
    for _ in range(rng.randrange(40)):
        lines.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) if rng.random() < 0.4 else rng.choice(words))
    return "\n".join(lines)


@pytest.mark.parametrize(("size", "overlap", "most"), [(5, 2, 40), (12, 0, 20), (30, 8, 1700), (800, 120, 1700)])
def test_random_documents(size, overlap, most):
    for seed in range(150):
        text = _random(seed)
        got = [(c.text, c.path) for c in C.chunk_one("Two  words", text, None, C.Budget(size=size, overlap=overlap, most=most))]
        assert got == plain("Two  words", text, size, overlap, most), (seed, text)


def test_documents_of_the_tables(spark, data):
    """Documents with planted headings, fences and tables; long sections are cut."""
    docs = queries.planted(spark, data).select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("text").alias("markdown"))
    budget = C.Budget(size=60, overlap=9, most=80)
    got = {}
    for r in C.chunk_documents(docs, budget).orderBy("document_id", "ordinal").collect():
        assert r.token_count == count(r.text) <= 80 and r.ordinal == len(got.setdefault(r.document_id, []))
        got[r.document_id].append((r.text, r.heading_path))
    some = docs.collect()
    for d in some:
        if len(d.markdown or "") < 20_000:  # the plain one takes its time
            assert got.get(d.document_id, []) == plain(d.title, d.markdown, 60, 9, 80), d.document_id
    assert max(map(len, got.values())) > 20 and any(p for chunks in got.values() for _, p in chunks)
    assert table(spark, data, "documents").count() == len(some)
