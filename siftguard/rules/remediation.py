"""Advice that replaces a rule's own when title and snippet match, in order of preference.

The title and snippet patterns and their order are fixed values. The wording is ours.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Remedy:
    title: str
    snippet: str
    note: str
    before: str
    after: str

    def text(self) -> str:
        return f"{self.note}\n\n  Before: {self.before}\n  After:  {self.after}"


_SQL = r"(?i)sql injection"
_COMMAND = r"(?i)command injection|os\.system|shell.?true"
_EVAL = r"(?i)eval|exec|code execution"
_PICKLE = r"(?i)pickle|deserialization"
_YAML = r"(?i)yaml\.load|deserialization"
_HASH = r"(?i)md5|sha1|weak.*crypt|hash"
_DEBUG = r"(?i)debug.*true|sensitive.*data"
_XSS = r"(?i)xss|cross.?site|mark_safe|innerHTML"

REMEDIES = [
    Remedy(_SQL, r"""(cursor\.\w+|\.execute)\s*\(\s*f["']""",
           "Leave a placeholder in the statement and let the driver bind the value; text built by an f-string becomes part of the SQL.",
           'db.execute(f"DELETE FROM sessions WHERE owner = {owner}")',
           'db.execute("DELETE FROM sessions WHERE owner = :owner", {"owner": owner})'),
    Remedy(_SQL, r"""(cursor\.\w+|\.execute)\s*\(\s*["'].*%s.*["']\s*%""",
           "Keep the percent sign out: a tuple as second argument is bound, a formatted string is not.",
           'db.execute("UPDATE stock SET amount = %s WHERE part = \'%s\'" % (amount, part))',
           'update(stock).where(stock.c.part == part).values(amount=amount)'),
    Remedy(_COMMAND, r"os\.system\s*\(",
           "Many shell commands have a library call that does the same without a shell.",
           'os.system("cp -r " + source + " " + target)',
           'shutil.copytree(source, target)'),
    Remedy(_COMMAND, r"subprocess\.\w+\(.*shell\s*=\s*True",
           "Name the program by its path and pass each argument as one list item.",
           'subprocess.check_output("git log -- " + path, shell=True)',
           'subprocess.check_output(["/usr/bin/git", "log", "--", path])'),
    Remedy(_EVAL, r"\beval\s*\(",
           "Look names up in a table of what is allowed instead of running the text.",
           'result = eval(operation + "(a, b)")',
           'result = {"add": operator.add, "mul": operator.mul}[operation](a, b)'),
    Remedy(_PICKLE, r"pickle\.load\s*\(",
           "A pickle can run code while it is read. Store arrays and tables in a format that holds data only.",
           'weights = pickle.load(open(path, "rb"))',
           'weights = numpy.load(path, allow_pickle=False)'),
    Remedy(_YAML, r"yaml\.load\s*\((?!.*Loader\s*=\s*yaml\.SafeLoader)",
           "Name a loader that knows no Python objects.",
           'for part in yaml.load_all(feed, Loader=yaml.Loader): ...',
           'for part in yaml.load_all(feed, Loader=yaml.CSafeLoader): ...'),
    Remedy(_HASH, r"hashlib\.md5\s*\(",
           "MD5 collisions take seconds. For passwords use a slow, salted function.",
           'stored = hashlib.md5(password + salt).digest()',
           'stored = hashlib.scrypt(password, salt=salt, n=2**15, r=8, p=1)'),
    Remedy(_HASH, r"hashlib\.sha1\s*\(",
           "SHA-1 collisions are practical. To authenticate a message, use a keyed digest.",
           'tag = hashlib.sha1(key + message).hexdigest()',
           'tag = hmac.new(key, message, "sha3_256").hexdigest()'),
    Remedy(_DEBUG, r"DEBUG\s*=\s*True\b",
           "Put the switch into a settings file that only development machines have.",
           'class Settings: DEBUG = True',
           'class DevelopmentSettings(Settings): DEBUG = sys.flags.dev_mode'),
    Remedy(_XSS, r"mark_safe\s*\(",
           "Let the template engine put values into markup; it escapes them.",
           'badge = mark_safe("<b>" + user.nickname + "</b>")',
           'badge = format_html("<b>{}</b>", user.nickname)'),
    Remedy(_XSS, r"dangerouslySetInnerHTML",
           "Render text as text; the framework escapes children.",
           '<td dangerouslySetInnerHTML={{__html: row.remark}}></td>',
           '<td>{row.remark}</td>'),
]
