"""Plain definitions of what the operators' queries return, text by text."""

import base64
import hashlib
import re
import zlib

import public_tokenizers as P
import tiktoken
import xxhash
from tokenizers import Tokenizer

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs):
    """{(doc_id, fingerprint, component_id)} in any order, as a sorted list."""
    prints = {i: fingerprint(t) for i, t in docs}
    roots = {i: i for i in prints}

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                roots[b] = a
    return sorted((i, f"{prints[i]:016x}", root(i)) for i in ids)


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    own, places = words(text), []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        want = phrase.split()
        places += [(i, label) for i in range(len(own)) if own[i : i + len(want)] == want]
    starts = [i for i, _ in places]
    return len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def token_files(docs):
    """doc_id: start, n_tokens, ids_crc32."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    out, start = {}, 0
    for i, text in sorted(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out[i] = start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        start += len(ids)
    return out


def ranks(name):
    lines = map(bytes.split, open(P.path(name), "rb"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def bpe(text, library):
    ids = library.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids))), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def pii(text):
    """n_email, n_ip, n_card, n_phone, base_sha256."""
    spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if _passes(k, m.group())]
    counts = [sum(k == kind for k, _, _ in spans) for kind in BASE]
    return *counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def contamination(docs, items):
    """doc_id: n_words, n_hit, n_items, items_sha256, contaminated."""
    patterns = []
    for item, text in items:
        own = words(text)
        patterns += [(item, own[i : i + 13]) for i in range(max(1, len(own) - 12))] if own else []
    out = {}
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, p in patterns:
            for at in range(len(own) - len(p) + 1):
                if own[at : at + len(p)] == p:
                    hit.update(range(at, at + len(p)))
                    found.add(item)
        listed = sorted(str(x) for x in found if x is not None)
        out[i] = len(own), len(hit), len(listed), sha(",".join(listed)), bool(hit) and 20 * len(hit) >= len(own)
    return out
