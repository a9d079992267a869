"""Fixed values of the rule checks: word lists, thresholds and labels, as plain text in natural order."""

BE_FORMS = ["is", "are", "was", "were", "am", "be", "been", "being"]
MODALS = ["has", "have", "had", "will", "would", "shall", "should", "can", "could", "may", "might", "must", "did", "does", "do"]
PARTICIPLES = [
    "given", "taken", "made", "done", "written", "sent", "held", "told", "shown", "known", "seen", "put", "set", "kept", "left",
    "brought", "thought", "found", "said", "paid", "built", "spent", "meant", "chosen", "broken", "spoken", "driven", "begun",
    "gone", "grown", "drawn", "worn", "torn", "sworn", "frozen", "stolen", "sold",
]
WORDY = ["in order to", "due to the fact that", "at this point in time", "a number of"]
NEGATIONS = [
    "not", "no", "never", "none", "neither", "nor", "nothing", "nobody", "cannot", "can't", "won't", "isn't", "aren't",
    "doesn't", "don't", "didn't", "without", "unless", "except", "excluding", "ineligible", "invalid", "unable",
    "unavailable", "noncompliant",
]
VAGUE_HEADINGS = ["overview", "general", "miscellaneous", "other", "details"]
JARGON = ["pursuant to", "notwithstanding", "aforementioned", "herein"]
DEFINITIONS = ["meaning", "that is", "i.e.", "in other words"]
NON_MUST = ["shall", "is required to", "are required to", "it is necessary that"]
SUPPORT_VERBS = [
    "make", "makes", "made", "perform", "performs", "performed", "conduct", "conducts", "conducted", "provide", "provides",
    "provided", "give", "gives", "gave", "take", "takes", "took",
]
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "being",
    "this", "that", "these", "those", "it", "as", "at", "from", "will", "shall", "must", "should", "may", "can", "could", "by", "not",
]
SUBSTITUTES = ["the applicant", "the undersigned", "this office", "the department"]
SUBORDINATORS = ["which", "that", "because", "although", "though", "while", "since", "unless", "whereas", "who", "whom", "whose", "if", "when"]
TRANSITIONS = [
    "however", "therefore", "in addition", "as a result", "moreover", "furthermore", "consequently", "nevertheless",
    "meanwhile", "similarly", "in contrast", "for example", "for instance", "in fact", "indeed", "likewise", "thus", "hence",
    "accordingly", "otherwise", "additionally", "also", "then", "next", "finally", "in summary",
]
INTRODUCERS = ["covers", "cover", "includes", "include", "requires", "require", "involves", "involve", "lists", "list", "comprises", "comprise", "needs", "need"]
CLAIM_MARKERS = ["therefore", "thus", "hence", "it follows that", "we recommend", "this paper argues", "i argue that", "the conclusion is", "in conclusion", "we should", "the case for"]
HEDGES = ["may", "might", "could", "possibly", "perhaps", "arguably", "somewhat", "relatively", "it seems", "appears to", "tends to", "to a degree"]

PASSIVE = rf"(?i)\b(?:(?:{'|'.join(MODALS)})\s+)?(?:{'|'.join(BE_FORMS)})\s+(?:\w+ed\b|\b(?:{'|'.join(PARTICIPLES)})\b)"
NOMINAL = rf"(?i)\b(?:{'|'.join(SUPPORT_VERBS)})\b(?:\s+\w+){{0,3}}?\s+(\w+(?:tion|sion|ment|ance|ence))\b"
STEPS = r"(?i)\b(?:first|second|third|fourth|fifth)\b,"
