"""Rules of the benchmark's judges as data: what pages must show, what the device must report, and what agents must answer.

Judges that extract records (operators.records) or compare steps (operators.trace) are code of their own and not rows here.
"""

from __future__ import annotations

# Answers that a finished task must give.
ANSWERS = {
    "bluecoins_1": "11,400.00 CNY",
    "bluecoins_2": "Buying cake",
    "bluecoins_3": "69.51 CNY",
    "bluecoins_4": "Three transactions",
    "bluecoins_5": "60.12 CNY",
    "cantook_1": "No",
    "cantook_2": "The Scarlet Letter",
    "cantook_3": "William Shakespeare",
    "cantook_4": "Two",
    "cantook_5": "37.8%",
    "clock_10": "7:30AM",
    "clock_11": "No",
    "clock_12": "Yes",
    "clock_13": "Two alarms",
    "clock_14": "No",
    "clock_16": "6 hours behind",
    "contacts_12": "22331144 or (223) 311-44",
    "contacts_13": "22334455@gmail.com",
    "contacts_14": "October 24, 1996",
    "contacts_15": "Tsinghua university",
    "map_1": "73 km, 12 hr 58 min",
    "map_2": "7.0 km, 8 min",
    "map_3": "4 hr 7 min",
    "map_4": "subway 824 and subway EB",
    "map_5": "public transportation",
    "map_6": "public transportation",
    "map_7": "Teléferic Barcelona",
    "map_8": "Teléferic Barcelona, about 3min",
    "map_9": "The Clement Hotel - All Inclusive",
    "map_10": "9min",
    "pimusic_1": "12 songs",
    "pimusic_2": "4 songs",
    "pimusic_3": "Pulse Live",
    "pimusic_4": "1 hour, 21 minutes and 3 seconds",
    "pimusic_5": "The second song is 'Dark Side Of The Moon' and the fourth song is 'Future sounds'",
    "pimusic_6": "11 minutes and 50 seconds",
    "setting_16": "English (United States)",
}

# Device commands whose output decides; the kind of test and what it tests for.
STATES = {
    "setting_0": ("state_differs", "adb shell settings get global airplane_mode_on", "0"),
    "setting_3": ("state_differs", "adb shell settings get global bluetooth_on", "1"),
    "setting_9": ("state_contains", "adb shell settings list system | grep volume_ring_speaker", "0"),
    "setting_10": ("state_contains", "adb shell settings list system | grep volume_alarm_speaker", "7"),
    "setting_14": ("answer_state", "adb shell 'getprop persist.sys.timezone'", ""),
    "setting_17": ("answer_state", "adb shell getprop ro.build.version.release", ""),
    "setting_20": ("state_lacks", "adb shell pm list packages | grep 'com.booking'", "booking"),
}

# Texts of a task's page, and texts of its sub-goals; an empty text always holds.
TEXTS = {
    "calendar_1": (["work"], ["", "Today", "5:00 PM"]),
    "calendar_2": (["homework"], ["", "May 21", "10 minutes before "]),
    "calendar_3": (["meeting"], ["", "May 13", "conference room B202 "]),
    "calendar_4": (["new month"], ["", "Jun 01", "Monthly"]),
    "calendar_5": (["work"], ["", "Today", "7:00 PM"]),
    "calendar_10": (["this_day"], [""]),
    "calendar_13": (["exam"], [""]),
    "clock_15": ([], ["London", "Barcelona"]),
    "contacts_1": (["Contact", "John"], ["John", "1 (234) 567-8"]),
    "contacts_6": (["Contact", "ABC"], ["00112233 "]),
    "contacts_8": (["Contact", "ABC"], ["abc.github.com"]),
    "contacts_9": (["Texting with ABC"], ["Texting with ABC", "Nice to meet you"]),
    "contacts_10": (["End call", "ABC"], [""]),
    "map_12": (["Stanford", "My location", "Start"], [""]),
    "map_13": (["University South", "My location", "Start"], [""]),
    "map_14": (["OpenAI", "My location", "Start"], [""]),
    "map_15": (["University of California, Berkeley", "My location", "Start"], [""]),
    "setting_2": (["Private DNS provider hostname"], ["dns.google"]),
    "setting_4": (["Pair new device"], ["my AVD"]),
    "setting_11": (["Text-to-speech output"], ["Chinese"]),
    "setting_12": (["Set time automatically"], ["May 1, 2024"]),
    "setting_21": (["Settings ", "Search settings"], [""]),
    "zoom_1": (["Join with a personal link name"], ["123 456 7890"]),
    "zoom_2": (["Join with a personal link name"], ["098 765 4321", "Alice"]),
}

# Texts of a task's page, and for each sub-goal the kind of test, the text beside which it looks, and the text.
BESIDE = {
    "contacts_2": (["Contact", "John Smith"], [("sibling_is", "1 (234) 567-8", "Call Mobile 1 (234) 567-8 "), ("sibling_is", "1 (234) 567-8", "Email Work 123456@qq.com ")]),
    "contacts_3": (["Contact", "Xu"], [("sibling_is", "1 (234) 567-8", "Call Work 1 (234) 567-8 "), ("sibling_is", "1 (234) 567-8", "Call Mobile (876) 543-21 ")]),
    "contacts_4": (["Contact", "Chen"], [("sibling_is", "Contact photo ", "Tsinghua University ")]),
    "contacts_7": (["Contact", "ABC"], [("sibling_is", "Birthday ", "October 24, 1996 ")]),
    "contacts_11": (["ABC ABC"], [("absent", "", "AAA AAA ")]),
    "setting_1": (["Turn on Wi‑Fi automatically"], [("sibling", "Turn on Wi‑Fi automatically", "unchecked")]),
    "setting_5": (["Battery percentage"], [("sibling_lacks", "Battery percentage", "unchecked")]),
    "setting_13": (["Ring vibration "], [("sibling", "Ring vibration ", "unchecked")]),
    "setting_15": (["Add a language"], [("has", "", "Español (Estados Unidos)"), ("next", "Español (Estados Unidos)", "2")]),
    "setting_19": (["Default browser app", "Firefox"], [("sibling_lacks", "Default browser app", "unchecked")]),
}


def rows() -> list[tuple[str, str, str, str, str]]:
    """(task_id, subgoal, kind, scope, arg) of every rule; 'page' is the subgoal of a gate."""
    out = [(task, "1", "answer", "", text) for task, text in ANSWERS.items()]
    out += [(task, "1", kind, scope, arg) for task, (kind, scope, arg) in STATES.items()]
    texts = {task: (gate, [("has" if t else "always", "", t) for t in goals]) for task, (gate, goals) in TEXTS.items()}
    for task, (gate, goals) in {**texts, **BESIDE}.items():
        out += [(task, "page", "has", "", t) for t in gate]
        out += [(task, str(i), *goal) for i, goal in enumerate(goals, 1)]
    return out
