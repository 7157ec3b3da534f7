"""The chat session machine: one transition, shared by the stream and the batch run."""

from __future__ import annotations

import json

import numpy as np

from spanledger.functions.text import GRATITUDE_EMOJI, GRATITUDE_WORDS

# Words and menu options the machine knows.
GREETINGS = ("hi", "hello", "start", "new", "0")
EXITS = ("7", "exit", "restart", "new")
OPTIONS = ("1", "2", "3", "4", "5", "6", "7")
FORMATS = {"1": "word", "2": "excel_rb", "3": "excel_amc"}
CATEGORIES = {"1": "bridge_details", "2": "general", "3": "damaged", "4": "observations", "5": "recommendations"}
IDLE = ("format_select", "menu", "confirm_generate", "confirm_exit")

EMPTY = {"no": 0, "open": False, "state": None, "format": None, "photos": 0, "details": False}

# One row per message: what was done, the state after it, and the counters.
OUTPUT = (
    "msg_id bigint, action string, reply string, category string, photo_num int, "
    "session_no int, state string, format string, is_open boolean"
)
OUTPUT_NAMES = [f.strip().split(" ")[0] for f in OUTPUT.split(",")]


def load(state: str | None) -> dict:
    return json.loads(state) if state else dict(EMPTY)


def save(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


def advance(s: dict, kind: str, content: str | None) -> dict:
    """Apply one message to the state of its phone; returns what happened."""
    raw = content or ""
    word = raw.lower().strip()
    done = {"action": "reply", "reply": None, "category": None, "photo_num": None}

    def say(reply: str, action: str = "reply") -> dict:
        return {**done, "action": action, "reply": reply}

    def close() -> None:
        s.update(open=False, state=None)

    def enter(state: str, reply: str, action: str = "state") -> dict:
        s["state"] = state
        return say(reply, action)

    def generate() -> dict:
        close()
        return say("generating", "generate")

    if any(w in word for w in GRATITUDE_WORDS) or any(e in raw for e in GRATITUDE_EMOJI):
        return say("thanks")
    if s["open"] and word in GREETINGS and s["state"] in IDLE:
        close()
    if word in EXITS:
        return enter("confirm_exit", "confirm_exit") if s["open"] else say("bye")
    if not s["open"]:
        if word == "done":
            return say("session_lost")
        s.update(no=s["no"] + 1, open=True, state="format_select", format=None, photos=0, details=False)
        if word not in FORMATS:
            return {**say("format_select", "open"), "category": "system"}

    state = s["state"]
    if state == "confirm_exit":
        if word == "yes":
            close()
            return say("bye", "exit")
        return enter("menu", "welcome_back") if word == "no" else say("yes_or_no")
    if state == "format_select":
        if word in FORMATS:
            s["format"] = FORMATS[word]
            return enter("menu", "menu", "format")
        return say("format_select")
    if state == "confirm_generate":
        if word == "6":
            return generate()
        return enter("1", "details") if word == "1" else say("six_or_one")
    if state == "menu":
        if word not in OPTIONS:
            return say("menu")
        if word == "6":
            return generate() if s["details"] else enter("confirm_generate", "no_details")
        return enter(word, {"1": "details", "4": "observations"}.get(word, "share"))

    if word == "done":
        return enter("menu", "menu")
    if word in OPTIONS and kind == "text":
        return say("use_done")
    category = CATEGORIES.get(state, "bridge_details")
    s["details"] = s["details"] or category == "bridge_details"
    if kind == "image":
        s["photos"] += 1
        return {"action": "filed", "reply": "photo_saved", "category": category, "photo_num": s["photos"]}
    return {"action": "filed", "reply": None, "category": category, "photo_num": None}


# A session format that is not known because it was chosen before the rows at hand.
BEFORE = "before"


def control_of(state: str | None) -> str:
    """What the next steps depend on; all else is counted or only passed on."""
    s = load(state)
    return json.dumps([s["open"], s["state"], s["details"]] if s["open"] else [False, None, False])


def controls() -> list[str]:
    states = [*IDLE, *(o for o in OPTIONS if o not in ("6", "7"))]
    return [control_of(None), *(json.dumps([True, s, d]) for s in states for d in (False, True))]


def start_from(control: str) -> str:
    is_open, state, details = json.loads(control)
    return save({"no": 0, "open": is_open, "state": state, "format": BEFORE, "photos": 0, "details": details})


def after(before: str | None, effect: str) -> str:
    """The state once the rows that led from ``start_from`` to ``effect`` follow ``before``.

    A session opened meanwhile counts its own photos; else they add up.
    """
    b, e = load(before), load(effect)
    same = e["no"] == 0
    return save(
        {
            **e,
            "no": b["no"] + e["no"],
            "photos": e["photos"] + (b["photos"] if same else 0),
            "format": b["format"] if e["format"] == BEFORE else e["format"],
        }
    )


def run(cols: dict[str, np.ndarray], state: str | None) -> tuple[dict[str, list], str]:
    """Apply messages of one phone in order (columns msg_id, type, content)."""
    s = load(state)
    out: dict[str, list] = {n: [] for n in OUTPUT_NAMES}
    for msg_id, kind, content in zip(cols["msg_id"], cols["type"], cols["content"]):
        done = advance(s, kind, content if isinstance(content, str) else None)
        row = {"msg_id": msg_id, **done, "session_no": s["no"], "state": s["state"], "format": s["format"], "is_open": s["open"]}
        for n in OUTPUT_NAMES:
            out[n].append(row[n])
    return out, save(s)
