"""Word lists, label sets and limits that results depend on."""

# Words a terminology span may not contain.
PROTECTED_TERMS = (
    "not never must should will won't cannot can't don't doesn't didn't isn't aren't wasn't "
    "weren't couldn't shouldn't wouldn't mustn't approved rejected agreed deadline percent "
    "percentage tomorrow yesterday today"
).split()

# Words that are never a terminology span on their own.
STOP_TERMS = (
    "a an the and or but if then this that these those it its is are was were be been being we "
    "our us you your he she they them their my i me to of for in on at as by with from please "
    "yes no okay thanks let can could would may might do does did have has had use using need "
    "want get make take go come said say also about more some any all so very much here there "
    "which what when where how why one two three four five six seven eight nine ten eleven "
    "twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion monday tuesday wednesday "
    "thursday friday saturday sunday january february march april june july august september "
    "october november december"
).split()

# Tokens that carry meaning an edit must not change.
PROTECTED_MEANING = (
    "not no never cannot won't don't doesn't didn't isn't aren't wasn't weren't shouldn't "
    "couldn't wouldn't mustn't might may could should must will would shall agreed approved "
    "rejected confirmed all some none one two three four five six seven eight nine ten eleven "
    "twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion half most percent "
    "percentage monday tuesday wednesday thursday friday saturday sunday january february march "
    "april may june july august september october november december today tomorrow yesterday am "
    "pm noon midnight second seconds minute minutes hour hours day days week weeks month months "
    "year years can can't deploy deadline jan feb mar apr jun jul aug sep oct nov dec before "
    "after kg g mg km m cm mm ft inch inches lb lbs l ml hz khz mhz ghz watt watts kw volt volts "
    "celsius fahrenheit utc gmt ist plus minus twice fewer more every each any"
).split()

# Negations, modality and date words counted separately.
NEGATIONS = (
    "not no never cannot won't don't doesn't didn't isn't aren't wasn't weren't shouldn't "
    "couldn't wouldn't mustn't can't"
).split()
MODALITY = (
    "might may could should must will would shall can agreed approved rejected confirmed"
).split()
DATE_WORDS = (
    "monday tuesday wednesday thursday friday saturday sunday january february march april may "
    "june july august september october november december jan feb mar apr jun jul aug sep oct "
    "nov dec today tomorrow yesterday am pm noon midnight utc gmt ist"
).split()

# Words ignored when two events are compared.
CONTENT_STOP = (
    "a an the we i you it this that to of for on in is are be and or will could should would do "
    "not no yes okay actually let lets by someone both our with if then"
).split()

# Closed label sets.
EVENT_TYPES = (
    "INFORMATION QUESTION ANSWER PROPOSAL SUPPORT OBJECTION REJECTION DECISION COMMITMENT "
    "TASK_ASSIGNMENT BLOCKER CLARIFICATION NONE AMBIGUOUS"
).split()
RELATION_TYPES = (
    "SUPPORTS ACCEPTS ANSWERS CONTRADICTS REJECTS SUPERSEDES CLARIFIES ASSIGNS RESULTS_IN NONE "
    "AMBIGUOUS"
).split()
HIGH_VALUE = ["DECISION", "TASK_ASSIGNMENT", "COMMITMENT", "BLOCKER"]
INTERJECTIONS = ["yes", "no", "okay", "right", "sure"]

# Characters a Markdown renderer would act on.
MARKDOWN_CONTROL = "\\`*_[]()#!|"

# Registered artifact kinds with file name and media type.
ARTIFACTS = [
    ("canonical_audio", "canonical.wav", "audio/wav"),
    ("raw_json", "raw_transcript.json", "application/json"),
    ("raw_txt", "raw_transcript.txt", "text/plain"),
    ("speaker_json", "speaker_transcript.json", "application/json"),
    ("speaker_txt", "speaker_transcript.txt", "text/plain"),
    ("refined_json", "refined_transcript.json", "application/json"),
    ("refined_txt", "refined_transcript.txt", "text/plain"),
    ("meeting_json", "meeting_record.json", "application/json"),
    ("meeting_md", "meeting_record.md", "text/markdown"),
    ("evidence_json", "evidence_manifest.json", "application/json"),
    ("diarization_json", "diarization.json", "application/json"),
    ("grounding_json", "grounding.json", "application/json"),
    ("grounding_txt", "grounding.txt", "text/plain"),
    ("edit_log_json", "edit_log.json", "application/json"),
]

# What a minute may be.
MINUTE_KINDS = ("discussion", "proposal", "concern", "information", "decision", "action")
