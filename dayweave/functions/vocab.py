"""Word lists and patterns the results depend on, in matching order."""

# Label -> substrings of a description; the first label with a hit wins.
DESCRIPTION_LABELS = [
    ("debugging", ["debugging", "troubleshooting", "investigating error", "reading error", "stack trace",
                   "exception thrown", "error message", "fixing bug"]),
    ("coding", ["writing code", "implementing", "developing", "programming", "refactoring", "coding"]),
    ("review", ["reviewing pr", "pull request", "code review", "reviewing code"]),
    ("meeting", ["in zoom", "in google meet", "in slack huddle", "video call", "screen sharing",
                 "team meeting"]),
    ("research", ["browsing", "stack overflow", "googling", "researching", "searching for"]),
    ("reading", ["reading documentation", "reading docs", "reading manual", "reading guide"]),
    ("terminal", ["in terminal", "in iterm", "command line", "running git", "running npm"]),
]

# Label -> first words of a description, tried after the list above.
FIRST_WORD_LABELS = [
    ("debugging", ["debug", "fix"]),
    ("coding", ["writing", "implementing", "developing"]),
    ("reading", ["reading"]),
    ("research", ["researching", "browsing"]),
]

# Activity synonym -> canonical label; exact match first, then first contained synonym.
ACTIVITY_SYNONYMS = [
    ("debugging", "debugging"),
    ("fixing bug", "debugging"),
    ("investigating error", "debugging"),
    ("troubleshooting", "debugging"),
    ("reading error", "debugging"),
    ("stack trace", "debugging"),
    ("coding", "coding"),
    ("writing code", "coding"),
    ("implementing", "coding"),
    ("developing", "coding"),
    ("programming", "coding"),
    ("reading", "reading"),
    ("reading docs", "reading"),
    ("documentation", "reading"),
    ("reading documentation", "reading"),
    ("research", "research"),
    ("browsing", "research"),
    ("searching", "research"),
    ("watching", "research"),
    ("stack overflow", "research"),
    ("googling", "research"),
    ("meeting", "meeting"),
    ("video call", "meeting"),
    ("zoom", "meeting"),
    ("google meet", "meeting"),
    ("screen share", "meeting"),
    ("terminal", "terminal"),
    ("command line", "terminal"),
    ("cli", "terminal"),
    ("shell", "terminal"),
    ("review", "review"),
    ("reviewing", "review"),
    ("code review", "review"),
    ("reviewing pr", "review"),
    ("pull request", "review"),
]

# Application alias -> canonical name; exact match first, then first contained alias.
APP_ALIASES = [
    ("ghosty", "Ghostty"),
    ("ghosttie", "Ghostty"),
    ("ghostty terminal", "Ghostty"),
    ("iterm", "iTerm"),
    ("iterm2", "iTerm"),
    ("iterm 2", "iTerm"),
    ("vs code", "VSCode"),
    ("visual studio code", "VSCode"),
    ("vscode", "VSCode"),
    ("visual studio", "VSCode"),
    ("chrome", "Google Chrome"),
    ("google chrome", "Google Chrome"),
    ("safari", "Safari"),
    ("firefox", "Firefox"),
    ("slack", "Slack"),
    ("zoom", "Zoom"),
    ("google meet", "Google Meet"),
    ("teams", "Microsoft Teams"),
    ("microsoft teams", "Microsoft Teams"),
    ("discord", "Discord"),
    ("whatsapp", "WhatsApp"),
    ("telegram", "Telegram"),
    ("notion", "Notion"),
    ("figma", "Figma"),
    ("github", "GitHub"),
    ("gitlab", "GitLab"),
    ("bitbucket", "Bitbucket"),
    ("terminal", "Terminal"),
    ("finder", "Finder"),
    ("mail", "Mail"),
    ("gmail", "Gmail"),
    ("calendar", "Calendar"),
    ("notes", "Notes"),
    ("spotify", "Spotify"),
    ("music", "Music"),
    ("photos", "Photos"),
    ("preview", "Preview"),
    ("quicktime", "QuickTime Player"),
    ("quicktime player", "QuickTime Player"),
    ("activity monitor", "Activity Monitor"),
    ("system preferences", "System Preferences"),
    ("settings", "System Settings"),
    ("system settings", "System Settings"),
    ("tableplus", "TablePlus"),
    ("postgres", "PostgreSQL"),
    ("postgresql", "PostgreSQL"),
    ("sqlite", "SQLite"),
    ("sqlitebrowser", "SQLite"),
]

# Names that are not applications.
APP_NOISE = [
    "a", "the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "unknown", "unidentified",
    "application", "app", "program", "software", "window", "screen", "desktop", "mac os", "macos",
    "os x", "operating system",
]

# Noise patterns for application names listed in observations.
APP_NOISE_PATTERNS = [
    r"(?i)^and\s", r"(?i)^a\s", r"(?i)^the\s", r"\.\.\.$", r"^\s*$", r"(?i)^file manager$",
    r"(?i)^personal website$",
]

# Applications counted as personal (exact names).
PERSONAL_APPS = [
    "WhatsApp", "Instagram", "TikTok", "Telegram", "Facebook", "Twitter", "Snapchat", "Discord",
    "Messenger", "Signal", "FaceTime", "iMessage", "Messages",
]

# Application hints in a description, one hit per pattern.
APP_HINTS = [
    r"in (vscode|vs code|visual studio code)",
    r"in (terminal|iterm|alacritty|warp)",
    r"in (chrome|safari|firefox|browser)",
    r"in (slack|discord|teams|zoom)",
    r"in (github|gitlab|bitbucket)",
    r"in (intellij|webstorm|pycharm)",
    r"using (vscode|terminal|chrome|slack)",
]

# Topic hints in a description, one hit per pattern.
TOPIC_HINTS = [
    r"working on (?:the )?(\w+)",
    r"(?:in|for) (?:the )?(\w+) project",
    r"(?:implementing|fixing|debugging) (\w+)",
]

# Phrases a speech model invents on silence; the first hit of each is removed.
HALLUCINATIONS = [
    r"(?i)untertitel.*amara\.org",
    r"(?i)www\.amara\.org",
    r"(?i)thanks for watching",
    r"(?i)please subscribe",
    r"(?i)like and subscribe",
    r"(.{20,})\1{4,}",
]

# Classification scores in declared order.
SCORES = ["meeting", "debugging", "tutorial", "learning", "working"]

# Request size steps in tokens.
CONTEXT_SIZES = [4096, 8192, 16384, 32768, 65536, 131072]

#: Whitespace trimmed from both ends of a text.
BLANKS = " \t\n\r\f\x0b "
