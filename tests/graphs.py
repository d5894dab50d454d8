"""Keys and tiny graphs for tests."""

import hashlib

#: Made-up keys, in ascending order of their digests.
EDA, FOX, SUE, TOM = sorted(hashlib.sha256(f"key {i}".encode()).hexdigest() for i in range(4))
BOB, ALICE = "0123456789abcdef" * 4, "9876543210fedcba" * 4
ROOT, L1A, L1B, L2A, L2B, L3A, L3B = (c * 64 for c in "abcdef1")


def event(author, follows, at=1000, kind=3, tags=None):
    tags = [["p", k] for k in follows] if tags is None else tags
    return {"id": "0" * 64, "pubkey": author, "created_at": at, "kind": kind, "tags": tags, "content": "", "sig": "0" * 128}


CHAIN = [event(EDA, [FOX]), event(FOX, [SUE])]
COMPLEX = [event(EDA, [FOX, SUE]), event(FOX, [SUE, TOM]), event(SUE, [EDA]), event(TOM, [EDA])]
