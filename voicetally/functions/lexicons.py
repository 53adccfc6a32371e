"""Word lists, lookup tables and patterns that results depend on."""

from __future__ import annotations

import datetime as dt

# Fixed values follow, in natural order.

#: A speaker label: capitals, an optional role after a comma, a colon and one white space.
LABEL = r"([A-Z][A-Z.'\-]+(?:\s+[A-Z][A-Z.'&\-]+){0,4})(?:,\s*([^:\n]{1,80}?))?:\s"
#: What may stand before a label, apart from the start of the text.
LABEL_BOUNDARY = (".", "?", "!", ":", '"', "'", ")", "]", "”", "’", "\n")
#: Markers around played clips.
CLIP_MARKER = r"\((BEGIN|END)\s+(?:VIDEO|AUDIO)[A-Z ]*\)"
URL_DATE = r"(\d{4})\.(\d{2})\.(\d{2})"
PARTY_TAG = r"(?i)(?:^|[\s(])([rdi])-[a-z]{2,}"
PARTY_WORDS = (("republican", "R"), ("democratic", "D"), ("democrat", "D"), ("independent", "I"))

STAFF_WORDS = ("host", "anchor", "correspondent", "analyst", "contributor", "cnn")

NONPERSON = (
    "unidentified male", "unidentified female", "unidentified participant", "unidentified speaker", "unidentified child",
    "unidentified reporter", "unidentified voice", "male", "female", "question", "announcer", "narrator", "audience", "crowd",
    "protesters", "voice", "voices", "automated voice", "computer voice", "recording", "graphic", "text",
)

TITLES_TWO_WORDS = ("vice president", "attorney general")
TITLES = (
    "president", "senator", "sen", "rep", "representative", "congressman", "congresswoman", "governor", "gov", "secretary",
    "attorney", "mayor", "ambassador", "justice", "judge", "general", "admiral", "colonel", "captain", "professor", "dr",
    "doctor", "mr", "mrs", "ms", "miss", "reverend", "rev", "father", "prince", "princess", "king", "queen", "chairman",
    "chairwoman", "director", "chief",
)

#: Keyword in a role -> office; the first keyword that occurs decides.
OFFICES = (
    ("vice president", "vice_president"), ("press secretary", "press_secretary"), ("prime minister", "diplomat"),
    ("foreign minister", "diplomat"), ("secretary-general", "diplomat"), ("secretary general", "diplomat"),
    ("ambassador", "diplomat"), ("president", "president"), ("u.s. senate", "senator"), ("senator", "senator"),
    ("sen.", "senator"), ("congressman", "representative"), ("congresswoman", "representative"),
    ("representative", "representative"), ("u.s. house", "representative"), ("rep.", "representative"),
    ("governor", "governor"), ("gov.", "governor"), ("attorney general", "cabinet_secretary"),
    ("secretary of", "cabinet_secretary"), ("mayor", "mayor"), ("spokesman", "spokesperson"),
    ("spokeswoman", "spokesperson"), ("spokesperson", "spokesperson"), ("candidate", "candidate"),
    ("prosecutor", "judiciary"), ("district attorney", "judiciary"), ("judge", "judiciary"), ("justice", "judiciary"),
    ("pentagon", "military"), ("army", "military"), ("navy", "military"), ("marine", "military"),
    ("air force", "military"), ("general", "military"), ("colonel", "military"), ("(ret.)", "military"),
    ("professor", "academic"), ("university", "academic"), ("dean", "academic"), ("journalist", "journalist"),
    ("reporter", "journalist"), ("columnist", "journalist"), ("editor", "journalist"), ("actor", "entertainment"),
    ("actress", "entertainment"), ("musician", "entertainment"), ("singer", "entertainment"),
    ("comedian", "entertainment"), ("director", "entertainment"), ("author", "entertainment"), ("ceo", "business"),
    ("chief executive", "business"), ("founder", "business"), ("chairman", "business"), ("chairwoman", "business"),
    ("rev.", "religious"), ("pastor", "religious"), ("bishop", "religious"), ("rabbi", "religious"), ("imam", "religious"),
)
EXECUTIVE = ("president", "vice_president", "cabinet_secretary", "press_secretary")

#: Presidents by day in office: first day, and the successor's first day.
PRESIDENTS = (
    ("bill clinton", "D", dt.date(1993, 1, 20), dt.date(2001, 1, 20)),
    ("george w. bush", "R", dt.date(2001, 1, 20), dt.date(2009, 1, 20)),
    ("barack obama", "D", dt.date(2009, 1, 20), dt.date(2017, 1, 20)),
    ("donald trump", "R", dt.date(2017, 1, 20), dt.date(2021, 1, 20)),
    ("joe biden", "D", dt.date(2021, 1, 20), dt.date(2025, 1, 20)),
    ("donald trump", "R", dt.date(2025, 1, 20), None),
)
#: Corpus formats by first day.
ERAS = (("era1", dt.date(2000, 1, 1)), ("era2", dt.date(2002, 9, 17)), ("era3", dt.date(2014, 6, 18)))

#: Written form -> the person it stands for; forms are normalized before use.
ALIASES = {
    "biden": "joe biden", "joe biden": "joe biden", "obama": "barack obama", "barack obama": "barack obama",
    "trump": "donald trump", "donald trump": "donald trump", "george w. bush": "george w. bush",
    "george bush": "george w. bush", "bush": "george w. bush", "hillary clinton": "hillary clinton",
    "mccain": "john mccain", "john mccain": "john mccain", "wolf blitzer": "wolf blitzer", "blitzer": "wolf blitzer",
    "anderson cooper": "anderson cooper", "cooper": "anderson cooper",
}
#: Show code -> host.
SHOW_HOSTS = {
    "acd": "Anderson Cooper", "ampr": "Christiane Amanpour", "lkl": "Larry King", "tsr": "Wolf Blitzer", "ebo": "Erin Burnett",
    "ng": "Nancy Grace",
}
#: Reporting verbs, by lemma.
CUE_VERBS = (
    "say", "tell", "state", "add", "note", "remark", "ask", "reply", "write", "tweet", "post", "argue", "claim", "insist",
    "warn", "acknowledge", "deny", "contend", "assert", "suggest", "concede", "allege", "announce", "explain", "report",
    "accuse", "urge", "vow", "predict", "recall", "complain", "respond", "confirm", "describe", "declare", "testify",
    "maintain", "admit",
)

# End of fixed values.
