import hashlib
import random
from collections import Counter, defaultdict

import pytest


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own(files):
    from vireo.llm.align import Aligner

    return Aligner(*files)


def brute(files, rows):
    """The contract on whole texts, by the two libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(files[0]), SentencePieceProcessor(model_file=files[1])
    tok.encode_special_tokens = True
    table, n = {}, 0
    for b in range(256):  # the byte-level alphabet
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    docs, counts = [], Counter()
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        a, b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        a_bytes = [bytes(table[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            docs.append((doc_id, None))
            continue
        ends = [set(), set()]
        for side, parts in enumerate((a_bytes, b_bytes)):
            at = 0
            for p in parts:
                at += len(p)
                ends[side].add(at)
        both, groups = sorted(ends[0] & ends[1]), defaultdict(lambda: ([], []))
        for side, (ids, parts) in enumerate(((a, a_bytes), (b, b_bytes))):
            at = 0
            for i, p in zip(ids, parts, strict=True):
                at += len(p)
                groups[next(e for e in both if e >= at) if len(both) < 2000 else both[__import__("bisect").bisect_left(both, at)]][side].append(i)
        links = Counter((x, y) for g in groups.values() for x in g[0] for y in g[1])
        counts.update(links.keys())
        docs.append((doc_id, (len(a), len(b), [groups[e] for e in both], links)))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for doc_id, d in docs:
        if d is None:
            yield doc_id, 0, 0, 0, 0, "", 0, 0
        else:
            n_a, n_b, groups, links = d
            said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            top = sum(m for p, m in links.items() if counts[p] == best[p[0]])
            yield doc_id, n_a, n_b, len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest(), top, sum(m * counts[p] for p, m in links.items())


def odd_texts():
    rng = random.Random(2)
    alphabet = ["a", "b", "é", "ﬁ", " ", " ", "  ", "\n", "\t", "日本", "🙂", "x́", "́", "don't", "1234", "<|endoftext|>", "</s>", "<0x41>", "\xa0", "　", "\x1c", "▁", "word", "Überlänge", "�", "\x00"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(250)]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in df.collect()), key=key)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "p") for i, t in rows], "doc_id long, text string, row long, pairs string").repartition(3)


def test_words_are_the_text():
    from vireo.llm.align import words

    for t in [*odd_texts(), "", " ", "  ", "a", " a b", "a  b c "]:
        assert " ".join(words(t)) == t


def told(f):
    from vireo.llm.align import added

    pairs, times = added(f.links)
    return f.ok, f.cut, f.prefix, f.suffix, ";".join(f.groups), f.n_groups, f.n_a, f.n_b, dict(zip(pairs.tolist(), times.tolist(), strict=True))


def test_fragments_compose_in_any_order(own):
    """Byte ranges cut anywhere, composed from the left, from the right and as a tree, are the whole."""
    from vireo.llm.align import Fragment, fragment

    rng = random.Random(1)
    for text in ["straightforward antidisestablishmentarianism 日本語テキスト ünïcödé", "x" * 40, "a b c"]:
        a, a_ends, b, b_ends = own.tokens(text)
        size = 1 + len(text.encode())
        whole = fragment(a, a_ends, b, b_ends, 0, size).whole()
        assert not whole.prefix[0] and not whole.suffix[0] and whole.n_a == len(a)
        for _ in range(40):
            cuts = [0, *sorted(rng.sample(range(1, size), min(size - 1, rng.randrange(0, 9)))), size]
            parts = [fragment(a, a_ends, b, b_ends, x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
            left = parts[0]
            for p in parts[1:]:
                left = left.then(p)
            right = parts[-1]
            for p in parts[-2::-1]:
                right = p.then(right)
            tree = parts
            while len(tree) > 1:
                tree = [tree[k].then(tree[k + 1]) if k + 1 < len(tree) else tree[k] for k in range(0, len(tree), 2)]
            for f in (left, right, tree[0]):
                assert told(f.whole()) == told(whole)


@pytest.mark.parametrize("size", [None, 60])
def test_alignment(spark, files, monkeypatch, size):
    """Odd texts, repeats and nulls; ranges so small that most documents are trees of several levels; counts partly joined."""
    from vireo.llm import align

    if size:
        monkeypatch.setattr(align, "SMALL", 3)
        monkeypatch.setattr(align, "RANGE", size)
        monkeypatch.setattr(align, "LONG", 45)
        monkeypatch.setattr(align, "FAN", 3)
        monkeypatch.setattr(align, "KNOWN", 40)
        monkeypatch.setattr(align, "BATCH", 7)
    texts = [None, "", " ", "one", "one", *odd_texts(), "Hello there general words and more words. " * 300, "y" * 300 + " 日本語" * 50, "long" * 700]
    rows = [(k if k % 9 else None if k % 2 else 3, t) for k, t in enumerate(texts)]
    assert found(align.align_documents(frame(spark, rows), *files)) == sorted(brute(files, rows), key=key)
    assert align.align_documents(frame(spark, rows).limit(0), *files).count() == 0
    assert found(align.align_documents(frame(spark, [(1, None), (2, "")]), *files)) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_whole_table(spark, sf, files):
    from vireo.llm import align

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert max(len(t.encode()) for _, t in rows) > align.RANGE  # so the tree has work here
    assert found(align.op13_fragment_alignment(spark, sf)) == sorted(brute(files, rows), key=key)
