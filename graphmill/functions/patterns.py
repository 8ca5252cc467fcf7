"""Patterns whose matches must equal the reference's. They hold in Python, Java and RE2 alike.

Fixed values: the web pattern is the public one of Django's validators with an optional scheme; mail addresses follow the
usual unquoted form of RFC 5322; a file name ends in a dot and letters or digits. All are anchored at the start and ignore
letter case; a mail address may be followed by more text. Addresses at a bracketed host (``a@[1.2.3.4]``) are left out.
"""

URL = r"^(?:(?:http|ftp)s?://)?(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
EMAIL = r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
FILENAME = r"^.*\.[a-z0-9]+$"
