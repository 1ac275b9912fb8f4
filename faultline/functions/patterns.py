r"""Patterns, tags and word lists that define the normal form of log texts.

Patterns are regular expressions in the dialect of ``java.util.regex``; groups are
written ``$1`` in replacements.
"""

# Fixed values ---------------------------------------------------------------

DATE_DASHES = r"\d+-\d+-\d+"
DATE_SLASHES = r"\d+/\d+/\d+"
TIME = r"\d+:\d+:\d+(?:[.,]\d+)?"
DELIMITER = r"(?:(?:\s*-\s*)|(?:\s*\|\s*))?"
STARTING_DATETIME = [
    rf"^{DATE_DASHES}\s+{TIME}{DELIMITER}\s*",
    rf"^{DATE_SLASHES}\s+{TIME}{DELIMITER}\s*",
    rf"^{TIME}{DELIMITER}\s*",
    rf"^\[{TIME}\]{DELIMITER}\s*",
    rf"^\[{DATE_DASHES}\s+{TIME}\]{DELIMITER}\s*",
]
LEVEL = r"(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s?"
STARTING_LEVEL = [rf"^{LEVEL}{DELIMITER}\s+", rf"^\[{LEVEL}\]{DELIMITER}\s+", rf"^\({LEVEL}\){DELIMITER}\s+"]
STARTING_THREAD_ID = [rf"^\d+\s+-+\s*{DELIMITER}\s+"]
STARTING_THREAD_NAME = [rf"^\[[^\]]*\]{DELIMITER}\s+"]
MARKDOWN_MARK = r"!!!MARKDOWN_MODE!!!\s*"

FILE_EXTENSIONS = ["java", "php", "cpp", "cs", "c", "h", "js", "swift", "rb", "py", "scala"]
EXCEPTION_ENDINGS = ["error", "exception", "failure"]
TRACEBACK_WORDS = ["stacktrace", "stack trace", "stack-trace", "traceback", "trace back"]

BRACKETED = r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}"
SPECIAL_CHARACTERS = r"[/?&=#@:.*!$%^+~\\|,;<>\[\]{}()`\"'_]"
WHOLE_NUMBER, DIGITS, NUMBER_TAG = r"\b\d+\b", r"\d+", "SPECIALNUMBER"
READABLE_NUMBER = "[EXCLUDED NUMBER]"

HTTP_CODE = r"[1-5]\d{2}"
STATUS_CODES = [
    rf"(?i)\bcode[^\w.]+({HTTP_CODE})\D*({HTTP_CODE})?|\bcode[^\w.]+({HTTP_CODE})?$",
    rf"(?i)\w+_code[^\w.]+({HTTP_CODE})\D*({HTTP_CODE})?|\w+_code[^\w.]+({HTTP_CODE})?$",
    rf"(?i)\bstatus[^\w.]+({HTTP_CODE})\D*({HTTP_CODE})?|\bstatus[^\w.]+({HTTP_CODE})?$",
    rf"(?i)\w+_status[^\w.]+({HTTP_CODE})\D*({HTTP_CODE})?|\w+_status[^\w.]+({HTTP_CODE})?$",
    rf"(?i)\bcode\W+expected[:.\s-]+[\"'`]?({HTTP_CODE})\D*({HTTP_CODE})?|\bcode\W+expected[:.\s-]+[\"'`]?({HTTP_CODE})[\"'`]?$",
    rf"(?i)\"(?:statusCode|status_code|httpCode|http_code|responseCode|response_code)\":\s*\"?({HTTP_CODE})\b",
]
STATUS_GROUPS = [3, 3, 3, 3, 3, 1]

STYLE_TAG = r"<style(?:\s+\S+\s*=\s*\"[^\"]*\")*\s*>[^<]*</style>"
SCRIPT_TAG = r"<script(?:\s+\S+\s*=\s*\"[^\"]*\")*\s*>[^<]*</script>"
HTML_TAGS = r"</?\w+(?:\s+[^>\s]+\s*=\s*\"[^\"]*\"\s?|\s+[^>\s]+\s*)*>|&([a-zA-Z0-9]+|#[0-9]{1,6}|#x[0-9a-fA-F]{1,6});"
HTML_START = r"<html(?:\s+\S+\s*=\s*\"[^\"]*\")*\s*>"
HTML_END = "</html>"

UUID_TAG = "SPECIALUUID"
UUIDS = [
    (r"\b[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\b", UUID_TAG),
    (r"\b[0-9a-fA-F]{16,48}|[0-9a-fA-F]{10,48}\.\.\.\b", UUID_TAG),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-(\w+)\b", f"{UUID_TAG} $1"),
]
HEX = [(r"\b0x[0-9a-fA-F]{12}\b", "SPECIALHEX")]

HORIZONTAL_SPACE = r"\h"
LINE_ENDING = rf"[{HORIZONTAL_SPACE}]*\r?\n"
SPACES = [(rf"[{HORIZONTAL_SPACE}]+", " "), (rf"[{HORIZONTAL_SPACE}]*\n[{HORIZONTAL_SPACE}]*", "\n")]

GENERATED_PARTS = [
    (r"\s*(?:at\s*)?(?:[a-zA-Z0-9_-]+\.)+(?:[a-zA-Z0-9_-]+\$\$)+[0-9a-f]+\.(?:[a-zA-Z0-9_-]+\$|\.)*[a-zA-Z0-9_-]+\(<generated>\).*", ""),
    (r"\b((?:[a-zA-Z0-9_-]+/|\\)+)([a-zA-Z0-9_-]+)\$([a-zA-Z0-9_-]+\.class)\b", "$1$2.$3"),
    (r"(?<=[.$])([a-zA-Z0-9_-]+)\$(?=[a-zA-Z0-9_-]+[.$(@])", "$1."),
    (r"\b((?:[a-zA-Z0-9_-]+\.)+)([a-zA-Z0-9_-]+)@[0-9a-f]+\b", "$1$2"),
    (r"\s*\.\.\. \d+ more.*", ""),
]
DOCUMENTATION_WORDS = ["documentation", "error", "visit"]

URL, URL_TAG = r"(?i)\b[\w+]+:/\S+\b", "SPECIALURL"
PATH = r"(?:^|\s|\"|'|`)[A-Za-z]:\\(?:[^:\\\r\n]+\\)*[^\s\\:\r\n]+|(?:^|\s|\"|'|`)/(?:(?:\\.|[^/\s\r\n])+/)*(?:\\.|[^/\s\r\n])+"
QUOTED = r"(?:^|\W)('.*'|\".*\")(?:\W|$)"
CREDENTIALS = r"^([^:/?#]+://)[^:/?#@]+:[^@/?#]*@"

TOKEN_NAMES = r"(?:access|refresh|biometric|jwt)_?token"
ACCESS_TOKENS = [
    (rf"(?i)(\"{TOKEN_NAMES}\"\s*:\s*\")[^\"]+", "$1SPECIALTOKEN"),
    (r"(?i)(Authorization\s*:\s*(?:Bearer|Basic|Digest|HOBA|Mutual|Negotiate|NTLM|VAPID|SCRAM|AWS4-HMAC-SHA256)) .*", "$1SPECIALTOKEN"),
]

SEPARATOR = r"(?:-{3,}=+|={3,}-+|`{3}|-{3,}|={3,}|_{3,})"
CODE_SEPARATORS = [
    (rf"\n{SEPARATOR}\n", " TEXTDELIMITER\n"),
    (rf"^{SEPARATOR}\n", " TEXTDELIMITER\n"),
    (rf"\s*{SEPARATOR}\n", " TEXTDELIMITER\n"),
    (rf"\n{SEPARATOR}\s+", "\nTEXTDELIMITER "),
    (rf"\s+{SEPARATOR}\s+", " TEXTDELIMITER "),
    (rf"^{SEPARATOR}\s*", "TEXTDELIMITER "),
    (rf"\s+{SEPARATOR}$", " TEXTDELIMITER"),
    (rf"{SEPARATOR}$", " TEXTDELIMITER"),
]
WEBDRIVER = [
    (r"(?:\s*-*>\s*)?Webdriver screenshot captured: [^/\x00\n.]+\.\w+", ""),
    (r"\s*Screenshot: file:/(?:[^/\x00\n]+/)*[^/\x00\n]+", ""),
    (r"\s*Page source: file:/(?:[^/\x00\n]+/)*[^/\x00\n]+", ""),
    (r"\s*Build info: version: '[^']+', revision: '[^']+'", ""),
    (r"\s*Driver info: [\w.]+", ""),
    (r"\s*System info: (?:[\w.]+: '[^']+', )+[\w.]+: '[^']+'", ""),
    (r"\s*Capabilities \{\w+: [^\n]+", ""),
]

SIMILARITY_SPECIALS = r"[.:/\\{}()\[\]\"',\-+=!@#$%^&*<>?|~`;_]"
CAMEL = [(r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z])([A-Z][a-z])", "$1 $2")]

IP_PORT = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d+"
LINE_NUMBER_AT_END = r":\d+(?=\)?\]?(?:\n|$))"
LINE_WORD = r"(?i)line\s*\d+\s*(?:(?=, in)|(?=,in)|(?=\n)|(?=$))"
CALL_AT = r"^\s*at\s[^(]*\([^)]*\)\s*$"
CALL_DOTTED = r"^\s*\w+([./]\s*\w+)+\s*\(.*?\)\s*$"

TEST_METHOD = r"\b[^\s()/\\:]+(?:Test|Step)s?\.[^\s()/\\:]*"
TEST_FILE = r"\b[^\s()/\\:]+\.(?:spec|cy)\.[jt]s\b"

#: English function words that are no terms.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

ERROR_LEVEL = 40000
CERTAIN_TYPES = ["ab", "pb", "si"]
