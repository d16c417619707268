"""Small hand-built episodes with known answers."""

import json

USER = {"_k": "e", "role": "user", "content": "hello"}
ORDER = "#W1"


def agent(calls=(), prompt=(1,), out=(2,), text="", lps=None, finish="stop"):
    return {"_k": "a", "role": "assistant", "text": text, "finish_reason": finish,
            "prompt_token_ids": list(prompt), "token_ids": list(out),
            "logprobs": list(lps if lps is not None else [-0.5] * len(out)),
            "tool_calls": [{"id": f"c{i}", "name": n, "arguments": a} for i, (n, a) in enumerate(calls)] or None}


def tool(content="{}", name="x"):
    return {"_k": "e", "role": "tool", "content": content, "tool_name": name}


def user(content="hello"):
    return {"_k": "e", "role": "user", "content": content}


def episode(eid, turns, **kw):
    base = dict(episode_id=eid, batch_id=17, policy_version="000-abc", task_id="tb_0042", group_id="b017-t0042",
                trial_index=0, seed=1, turns=turns, reward=1, termination="natural", db_hash_before="x",
                db_hash_after="y", wall_clock_s=1.0, recorded_at="2024-01-01T00:00:00+00:00", schema_version=1, extra={})
    return {**base, **kw}


def swap(old, new, **more):
    return ("exchange_delivered_order_items", {"order_id": ORDER, "item_ids": list(old), "new_item_ids": list(new), **more})


CANCEL = ("cancel_pending_order", {"order_id": ORDER})
ADDRESS = ("modify_user_address", {"user_id": "u1", "zip": "1"})
GET = lambda o: ("get_order_details", {"order_id": o})

RECORDS = {
    "clean": episode("clean", [agent(prompt=[1, 2, 3], out=[10, 11]), user(), agent(prompt=[1, 2, 3, 10, 11, 50], out=[12])]),
    "dirty": episode("dirty", [agent(prompt=[1, 2, 3], out=[10, 11]), user(), agent(prompt=[1, 99, 3, 10, 11, 50], out=[12])]),
    "uw": episode("uw", [agent([CANCEL, ADDRESS]), tool("Error: no"), tool(), agent([CANCEL]), tool()], reward=0),
    "gp": episode("gp", [agent([swap("ba", "BA")]), tool()], reward=0),
    "gq": episode("gq", [agent([swap("ab", "BA")]), tool()], reward=0),
    "gr": episode("gr", [agent([swap("ab", "AX")]), tool()], reward=0),
    "rp": episode("rp", [agent([GET("#W1")]), tool(), agent([GET("#W2")]), tool(), agent([GET("#W1")]), tool(),
                         agent([swap("ba", "BA")]), tool(), agent([swap("ab", "AB")]), tool()], reward=0),
    "length": episode("length", [agent([swap("ba", "BA")]), tool()], reward=0, termination="length"),
}
SWAP_GOLD = {"name": "exchange_delivered_order_items",
             "arguments": {"order_id": ORDER, "item_ids": ["a", "b"], "new_item_ids": ["A", "B"]}}
ADDRESS_GOLD = {"name": "modify_user_address", "arguments": {"user_id": "u1", "zip": "1"}}
GOLD = {"uw": [{"name": "cancel_pending_order", "arguments": {"order_id": ORDER}}],
        "gp": [SWAP_GOLD, {"name": "modify_pending_order_address", "arguments": {"order_id": ORDER, "zip": "1"}}],
        "gq": [SWAP_GOLD], "gr": [SWAP_GOLD], "rp": [SWAP_GOLD], "length": [SWAP_GOLD]}


def gold_rows():
    return [(k, [(g["name"], json.dumps(g["arguments"])) for g in v]) for k, v in GOLD.items()]
