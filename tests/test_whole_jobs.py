"""Registered queries over the whole of their tables, against plain Python."""

import hashlib

import pyarrow.parquet as pq

from weftline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.01"  # has ids that occur twice


def test_joined_contexts_of_all_prompts(spark):
    last = {}
    for r in sorted(pq.read_table(f"{DATA}/system_prompts.parquet").to_pylist(), key=lambda r: r["generation_batch"]):
        last[r["id"]] = len(r["system_prompt"])
    ring = sorted(last, key=lambda i: hashlib.md5(f"{i}#7".encode()).hexdigest())
    want = {i: sum(last[ring[(k + j) % len(ring)]] for j in range(3)) + 4 for k, i in enumerate(ring)}
    got = [(r.id, r.chars) for r in QUERIES["joined_contexts"](spark, DATA).collect()]
    assert len(got) == 150 and dict(got) == want


def test_zipped_turns_of_whole_conversations(spark):
    want = {}
    for r in pq.read_table(f"{DATA}/ift_data_pwc.parquet").to_pylist():
        if r["context"] is not None and r["conversations"] is not None:
            roles = [m["role"] for m in r["conversations"]]
            want[r["item_id"]] = 2 * sum(x == ("user", "assistant") for x in zip(roles, roles[1:]))
    got = [(r.item_id, r.messages) for r in QUERIES["zipped_turns"](spark, DATA).collect()]
    assert len(got) == len(want) and dict(got) == want and max(want.values()) > 4
