"""The rule book's judges against a plain reading of the same rules over nested dictionaries."""

import random
import re

import pytest

from veilframe.operators import rulebook, verdicts
from veilframe.operators.screens import THIN_SPACE

NODES = "trace_id string, step int, node_id int, last_id int, parent_id int, key string"
STEPS = "trace_id string, step int, task_id string, command map<string,string>, answer string, finished boolean"


def _rows(tree, out=None, parent=None):
    """Node rows (node_id, last_id, parent_id, key) of nested lists [(key, children)]."""
    out = [] if out is None else out
    for key, below in tree:
        at = len(out)
        out.append([at, at, parent, key])
        _rows(below, out, at)
        out[at][1] = len(out) - 1
    return out


def _run(spark, cases):
    """cases: [(trace, step, task, tree, command, answer, finished)] to {(trace, step): row}."""
    steps = [(c[0], c[1], c[2], c[4], c[5], c[6]) for c in cases]
    nodes = [(c[0], c[1], *n) for c in cases for n in _rows(c[3])]
    out = verdicts.judge(spark.createDataFrame(steps, STEPS), spark.createDataFrame(nodes, NODES)).collect()
    return {(r.trace_id, r.step): (r.page, r.subgoals, r.complete) for r in out}


# --- a plain reading


def _topmost(tree, text):
    for key, below in tree:
        if text in key:
            yield key, below
        else:
            yield from _topmost(below, text)


def _families(tree, text, top=True):
    """(parent's key, children) as a search that leaves a level at its first hit finds them; None at the top."""
    for key, below in tree:
        if text in key:
            return [] if top else [tree]
        # what is below comes before what follows
        for f in _inner(key, below, text):
            yield f
    return []


def _inner(parent, level, text):
    for key, below in level:
        if text in key:
            yield parent, level
            return
        yield from _inner(key, below, text)


def _keys(tree, text):
    return [k for _, level in _families(tree, text) for k, _ in level]


def _texts(tree, mark="TextView"):
    return [k.split(";; ;;")[-1].strip() for k, _ in _topmost(tree, mark)]


def _all(tree):
    for key, below in tree:
        yield key, below
        yield from _all(below)


def _is_on(key):
    return "checked" in key and "unchecked" not in key


def _bill(tree):
    plain = [k for k, _ in _topmost(tree, "TextView ;; ;;")]
    out = dict(type="", date="", cash="", note="")
    if plain:
        said = plain[0].split(";; ;;")[-1].split()
        out["type"] = said[-1] if said else ""
        months = "January|February|March|April|May|June|July|August|September|October|November|December"
        out["date"] = next((k.split(";; ;;")[-1].strip() for k in plain if re.search(months, k)), "")
    for _, level in list(_families(tree, "click ; ;;CNY"))[:1]:
        for k, _ in level:
            if "EditText" in k and "long-click" in k:
                out["cash"] = k.split(";;")[-1].strip()
    fields = [k for k, _ in _topmost(tree, "EditText")]
    if fields:
        note = fields[-1].split(";;")[-1].strip()
        out["note"] = "None" if note in ("Notes", "Payee or item purchased", "Name of income") else note
    return out


def _alarms(level):
    out, now, unfolded = [], {"days": []}, False
    for key, _ in level:
        if "Collapse" in key:
            unfolded = True
        if ("Delete" in key or "Add alarm" in key) if unfolded else ("Switch" in key and "checked" in key):
            out.append({**now, "status": "unchecked" if "unchecked" in key else "checked"})
            now, unfolded = {"days": []}, False
        if "AM" in key or "PM" in key:
            now["time"] = key
        for field, mark in (("label", "Label"), ("ringtone", "Ringtone")):
            if mark in key:
                now[field] = key
        now["days"] += [d for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "Not scheduled", "Today", "Tomorrow", "Every day") if d in key and "TextView" in key]
        if "Vibrate" in key:
            now["vibrate"] = "unchecked" if "unchecked" in key else "checked"
    return out


def _word(key, mark):
    part = next((p for p in (key or "").split(";") if mark in p), None)
    return None if part is None else part.split(mark)[0].rstrip()


def _fits(a, asked):
    time = a.get("time")
    if "time" in asked and not (time and all(t in time for t in asked["time"].split("&"))):
        return False
    if "after" in asked:
        part = next((p for p in (time or "").split(";") if "PM" in p), None)
        m = part and re.fullmatch(r"(\d+):(\d+)", part.split(THIN_SPACE)[0])
        if not m or int(m[1]) * 60 + int(m[2]) <= int(asked["after"]):
            return False
    got = {"days": ",".join(a["days"]), "label": _word(a.get("label"), "Label"), "ringtone": _word(a.get("ringtone"), "Ringtone"), "vibrate": a.get("vibrate"), "status": a["status"]}
    return all(got[k] == v for k, v in asked.items() if k in got)


def _durations(tree):
    said, pattern = _texts(tree, "TextView ;; ;;"), r"(\d+:)?[0-5]?\d:[0-5]?\d"
    first = next((i for i in range(4) if i + 2 < len(said) and re.fullmatch(pattern, said[i + 2])), 0)
    out = []
    for i in range(first, len(said) - 2, 3):
        if not re.fullmatch(pattern, said[i + 2]):
            break
        n = 0
        for p in said[i + 2].split(":"):
            n = n * 60 + int(p)
        out.append(n)
    return out


def _contains_all(words, truth):
    return truth.lower() in words.lower()


def _leaf(x, tree, command, answer, finished):
    _, kind, scope, arg, asked = x
    asked, parts, kids = dict(asked), arg.split("|"), lambda: _keys(tree, scope)
    tops = lambda t: list(_topmost(tree, t))
    if kind.startswith("answer"):
        out = (command or {}).get(scope)
        truth = arg if kind == "answer" else (out or "") if kind == "answer_state" else parts[1] if out == parts[0] else parts[2]
        return finished and answer is not None and truth != "" and _contains_all(answer, truth)
    if kind == "time_beside":
        hits = [k for k in kids() if parts[0] in k]
        return bool(hits) and " ".join(hits[-1].split(parts[0])[-1].split()[:2]) == parts[1]
    if kind == "section":
        begins, ends = scope.split("|")
        inside = hit = False
        for _, level in _families(tree, begins):
            for k, below in level:
                hit |= inside and any(arg in c for c, _ in below)
                inside = (inside or begins in k) and ends not in k
        return hit
    if kind in ("next_contains", "next_on"):
        ks = kids()
        if kind == "next_contains":
            return any(scope in a and arg in b for a, b in zip(ks, ks[1:]))
        at = next((i for i, k in enumerate(ks) if scope in k), None)
        return at is not None and at + 1 < len(ks) and _is_on(ks[at + 1])
    if kind == "first_family":
        f = next(iter(_families(tree, scope)), None)
        return f is not None and arg not in f[0] and any(arg in k for k, _ in _all(f[1]))
    if kind == "last_share":
        fs = list(_families(tree, scope))
        k = next((k for k, _ in fs[-1][1] if "%" in k), None) if fs else None
        return k is not None and k.split(";")[-1].rstrip() == arg
    if kind == "spoken":
        said = [k for k, _ in tops("TextView") if "hour" in k and "minute" in k and "second" in k]
        return any(k.split(scope)[0].rstrip().split(" ")[-1] == arg for k in said)
    listed = lambda: not (len(tops("Alarm")) == 0 or (len(tops("Alarm")) == 1 and "click ; ;;Alarm" in tops("Alarm")[0][0]))
    return {
        "has": lambda: bool(_keys(tree, arg)), "beside": lambda: any(arg in k for k in kids()), "beside_is": lambda: any(k.split(";")[-1] == arg for k in kids()),
        "beside_after": lambda: any(parts[0] in k and k.split(parts[0])[-1].rstrip() == parts[1] for k in kids()), "beside_on": lambda: any(_is_on(k) and arg in k for k in kids()),
        "beside_miscounts": lambda: any(scope in k and parts[0] in k.split(";")[-1] and parts[1] not in k.split(";")[-1] for k in kids()),
        "below_is": lambda: any(c.split(";")[-1] == arg for _, level in _families(tree, scope) for _, below in level for c, _ in below),
        "within": lambda: any(arg in k for key, below in _all(tree) if scope in key for k, _ in [(key, below), *_all(below)]),
        "first_tab": lambda: bool(tops("focusable ; selected ; selected")) and arg in tops("focusable ; selected ; selected")[0][0], "single": lambda: len(tops(arg)) == 1,
        "text": lambda: arg in _texts(tree), "text_part": lambda: any(all(p in t for p in parts) for t in _texts(tree)), "text_every": lambda: all(any(p in t for p in parts) for t in _texts(tree)),
        "falling": lambda: _durations(tree) == sorted(_durations(tree), reverse=True), "rising": lambda: _durations(tree) == sorted(_durations(tree)),
        "bill": lambda: (_bill(tree)[scope].lower() if scope == "note" else _bill(tree)[scope]) in parts, "bill_filled": lambda: any(_bill(tree)[f] for f in ("cash", "note")),
        "sign": lambda: next((s for s in (k.split("; ;;")[-1].strip() for k, _ in tops("TextView ;click")) if s in "+-" and s), None) == arg,
        "alarm_list": listed, "alarm": lambda: any(_fits(a, asked) for _, level in _families(tree, "Alarm") for a in _alarms(level)),
        "alarm_below": lambda: any(_fits(a, asked) for _, below in tops("Alarm") for a in _alarms(below)), "size": lambda: any(p in k for k in kids() for p in parts),
        "always": lambda: True, "finished": lambda: finished, "reported": lambda: scope in (command or {}), "state_equals": lambda: (command or {}).get(scope) == arg,
        "state_contains": lambda: arg in (command or {}).get(scope, "") and scope in (command or {}),
    }[kind]()


def _holds(x, now, held):
    if x[0] == "leaf":
        return _leaf(x, *now)
    if x[0] == "not":
        return not _holds(x[1], now, held)
    if x[0] in ("ever", "before"):
        return any(_holds(x[1], then, []) for then in (held + [now] if x[0] == "ever" else held))
    return {"all": all, "any": any}[x[0]](_holds(p, now, held) for p in x[1:])


def _plain(cases):
    out, held = {}, {}
    for trace, step, task, tree, command, answer, finished in sorted(cases, key=lambda c: (c[0], c[1])):
        r, now = rulebook.RULES[task], (tree, command, answer, finished)
        before = held.setdefault((trace, task), [])
        page = _holds(r["page"], now, before)
        goals, complete = None, None
        if page:
            goals = {}
            for i, g in enumerate(r["goals"], 1):
                if g[0] == "said":
                    _, _, scope, arg, _ = g[1]
                    goals[str(i)] = next((k.split(";")[-1] for k in _keys(tree, scope) if any(p in k for p in arg.split("|"))), None)
                else:
                    goals[str(i)] = str(_holds(g, now, before)).lower()
            complete = None if r["complete"] is None else _holds(r["complete"], now, before)
        out[trace, step] = (page, goals, complete)
        before.append(now)
    return out


PREFIXES = ["TextView ;; ;;", "Switch ;click check ; checked ;;", "Switch ;click check ; unchecked ;;", "EditText ;click long-click ; ;;", "TextView ;click ; ;;", "RecyclerView ;; ;;", ";focusable ; selected ; selected, ;", "[n3] ;; ;;", ";click ; ;;CNY "]
FIELDS = [f"7:00{THIN_SPACE}AM", f"3:00{THIN_SPACE}PM", f"1:15{THIN_SPACE}PM", "Mon", "Tue", "Every day", "meeting Label ", "Argon Ringtone ", "Vibrate ", "Collapse ", "Delete ", "2:30", "1:02:03", "40 MB ", "50% ", "Alarm ", "1 hour 15 minutes 0 seconds", "Bedtime 10:00 PM", "+", "-", "May 15, 2024 ", "3 contacts ", "2 contacts "]


def _random_tree(rng, texts, depth=0):
    out = []
    for _ in range(rng.choice([1, 2, 4] if depth else [1, 3])):
        text = rng.choice(texts) if rng.random() < 0.7 else rng.choice(FIELDS)
        out.append((rng.choice(PREFIXES) + text, _random_tree(rng, texts, depth + 1) if depth < 3 and rng.random() < (0.5 if depth else 1) else []))
    return out


@pytest.mark.parametrize("app", ["bluecoins", "calendar", "cantook", "clock", "contacts", "map", "pimusic", "setting", "zoom"])
def test_rules_read_as_plain_python_does(spark, app):
    rng = random.Random(app)
    cases = []
    for task in (t for t in rulebook.RULES if t.startswith(app + "_")):
        texts = [t for _, t in verdicts.leaf_texts([task])] + [v for x in verdicts.compiled(task, rulebook.RULES[task])[1] for v in x[3].values()]
        commands = [x[1] for x in verdicts.compiled(task, rulebook.RULES[task])[1] if x[0] in ("reported", "state_equals", "state_contains")]
        for trace in range(6):
            for step in range(5):
                command = rng.choice([None, {c: rng.choice(["0", "1", " 1\n", "7", "booking", "12"]) for c in commands}])
                cases.append((f"{task}/{trace}", step, task, _random_tree(rng, texts or FIELDS), command, rng.choice([None, "", *(f"it is {t}" for t in texts)]), rng.choice([True, False])))
    rng.shuffle(cases)
    got, want = _run(spark, cases), _plain(cases)
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, list(wrong.items())[:3]
    assert len(got) == len(cases) and any(p for p, _, _ in want.values()) and (app in ("map",) or any(c for _, _, c in want.values()) or app == "clock")


def test_rule_book_is_whole():
    counts = {}
    for t in rulebook.RULES:
        counts[t.split("_")[0]] = counts.get(t.split("_")[0], 0) + 1
    assert counts == {"bluecoins": 15, "calendar": 14, "cantook": 12, "clock": 27, "contacts": 15, "map": 15, "pimusic": 12, "setting": 23, "zoom": 5}


def test_bills_are_judged_after_they_were_seen_as_they_were(spark):
    page = lambda cash, date="May 15, 2024": [("root", [("TextView ;; ;;Edit Expense ", []), (f"TextView ;; ;;{date} ", []), ("View ;; ;;box", [("TextView ;click ; ;;CNY ", []), (f"EditText ;click long-click ; ;;{cash} ", [])])])]
    cases = [("a", i, "bluecoins_11", page(c), None, None, False) for i, c in enumerate(["500.00", "400.00", "500.00", "400.00"])]
    got = _run(spark, cases)
    assert [got["a", i][0] for i in range(4)] == [False, False, True, True]
    assert [got["a", i][2] for i in range(4)] == [None, None, True, False]


def test_steps_without_a_page_or_a_rule(spark):
    got = _run(spark, [("a", 0, "zoom_4", [], None, None, None), ("a", 1, "unknown", [], None, "x", True), ("b", 0, "bluecoins_3", [], None, "69.51 CNY", True), ("c", 0, "setting_22", [("r", [("x", [])])], {"adb shell settings get global airplane_mode_on": "0"}, "it is not open", True)])
    assert got == {("a", 0): (False, None, None), ("b", 0): (True, {"1": "true"}, True), ("c", 0): (True, {"1": "true"}, True)}
    with pytest.raises(ValueError, match="no test"):
        verdicts.leaf("unheard")
    with pytest.raises(ValueError, match="another"):
        verdicts.compiled("t", verdicts.rule(verdicts.ever(verdicts.before(verdicts.has("x"))), verdicts.has("y")))


def test_added_rules_replace(spark):
    verdicts.register_rule("zoom_4", verdicts.rule(verdicts.has("x"), verdicts.not_(verdicts.has("y"))))
    try:
        got = _run(spark, [("a", 0, "zoom_4", [("r", [("x", [])])], None, None, False), ("a", 1, "zoom_4", [("r", [("x", []), ("y", [])])], None, None, False)])
    finally:
        verdicts._REGISTERED.clear()
    assert got == {("a", 0): (True, {"1": "true"}, True), ("a", 1): (True, {"1": "false"}, False)}
