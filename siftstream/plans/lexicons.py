"""Word lists, patterns and labels. Lexicons are parameters of the operators; these are the domain's."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """Words that score or classify a text."""

    top: tuple[str, ...]
    middle: tuple[str, ...]
    light: tuple[str, ...]
    priority: tuple[str, ...] = ()
    penalised: tuple[str, ...] = ()
    grave: tuple[str, ...] = ()
    serious: tuple[str, ...] = ()


def _words(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.replace("\n", " ").split(",") if x.strip())


# The domain's word lists, which results depend on.
NEWS = Lexicon(
    top=_words("""fed rate, fomc, cpi report, jobs report, election result, rate hike, rate cut, war declared, coup, nuclear,
        sanctions, default, resign, assassination, rate decision, indicted, military, airstrike, invasion, fomc statement,
        known exploited vulnerability, kev catalog, emergency alert, tornado warning, hurricane warning, major earthquake"""),
    middle=_words("""interest rate, inflation, gdp, earnings, acquisition, ipo, championship, trade deal, fda approval,
        bitcoin etf, sec ruling, arrested, fired, hired, merger, bankruptcy, tariff, material definitive agreement,
        results of operations, regulation fd disclosure, guidance, recall, class i, class ii, cve, vulnerability, exploit,
        data breach, cyberattack, severe thunderstorm warning, flash flood warning, earthquake"""),
    light=_words("poll, survey, forecast, record high, record low, quarterly results, announced, confirmed, signed, reportedly"),
    priority=_words("""apple, aapl, microsoft, msft, google, alphabet, googl, goog, amazon, amzn, meta, facebook, tesla, tsla,
        nvidia, nvda, amd, oracle, orcl, salesforce, netflix, nflx, intel, intc, palantir, pltr, broadcom, avgo, jpmorgan, jpm,
        goldman sachs, goldman, bank of america, wells fargo, morgan stanley, citigroup, citi, lockheed martin, raytheon, rtx,
        boeing, ba, exxon, xom, chevron, cvx, s&p 500, sp500, nasdaq, dow jones, russell 2000, bitcoin, btc, ethereum, eth,
        solana, sol"""),
    penalised=_words("""burglary, burglar, robbery, mugging, mugged, carjacking, drug bust, drug raid, narcotics raid, heroin bust,
        cocaine bust, cocaine seizure, arson, vandalism, vandalized, shoplifting, pickpocket, home invasion"""),
    grave=_words("killed, casualties, victims, fatalities, shooting, bombing, terror, terrorist, hostage, massacre, murder, murdered"),
    serious=_words("""doj, sec charges, criminal, indicted, arrested, lawsuit, legal, conviction, guilty verdict, nuclear, sanctions,
        assassination, attack, death, data breach, cyberattack, kev catalog, class i recall, political, election, controversy,
        scandal, protest, conflict"""),
)

#: Words that do occur in the synthetic tables.
BENCH = Lexicon(
    top=("worthless", "disgusting", "pathetic", "license"), middle=("that", "with", "of the"), light=("the", "and"),
    priority=("public", "der", "que"), penalised=("idiot", "scum"), grave=("worthless", "loser"), serious=("license", "the", "les"),
)

# Ordered tags with their words; spaces at the ends of a word count.
GEO_TAGS: dict[str, list[str]] = {
    "🇺🇸 United States": ["united states", "u.s.", " usa", "american", "washington", "biden", "trump", "congress", "white house", "pentagon", "federal reserve", "wall street", "new york"],
    "🇨🇳 China": ["china", "chinese", "beijing", "xi jinping", "ccp", "pla", "taiwan strait", "shanghai"],
    "🇷🇺 Russia": ["russia", "russian", "moscow", "putin", "kremlin", "wagner"],
    "🇺🇦 Ukraine": ["ukraine", "ukrainian", "kyiv", "zelensky", "kharkiv", "odesa"],
    "🇮🇷 Iran": ["iran", "iranian", "tehran", "khamenei", "irgc", "persian"],
    "🇮🇱 Israel": ["israel", "israeli", "tel aviv", "netanyahu", "idf", "gaza", "west bank"],
    "🇪🇺 European Union": ["european union", " eu ", "ecb", "brussels", "eurozone", "european commission"],
    "🇬🇧 United Kingdom": [" uk ", "britain", "british", "london", "downing street", "bank of england", "boe"],
    "🌏 Middle East": ["middle east", "saudi arabia", "riyadh", "iraq", "baghdad", "syria", "lebanon", "hezbollah", "hamas", "houthi", "yemen"],
    "🇩🇪 Germany": ["germany", "german", "berlin", "bundesbank", "scholz"],
    "🇯🇵 Japan": ["japan", "japanese", "tokyo", "boj", "bank of japan", "nikkei"],
    "🇰🇷 South Korea": ["south korea", "korean", "seoul", "yoon"],
}
TOPIC_TAGS: dict[str, list[str]] = {
    "🗳 Elections": ["election", "ballot", "primary", "candidate", "poll result", "votes counted", "runoff", "referendum"],
    "💰 Rates/Central Banks": ["fed rate", "fomc", "interest rate", "rate cut", "rate hike", "central bank", "monetary policy", "boe rate", "ecb rate", "inflation data", "cpi report", "jobs report"],
    "💥 Military/Conflict": ["airstrike", "military operation", "troops", "missile", "drone attack", "invasion", "ceasefire", "casualties", "bombing"],
    "⚖️ Sanctions/Legal": ["sanctions", "indicted", "sec charges", "doj", "criminal charges", "lawsuit", "court ruling", "impeach"],
    "🪙 Crypto": ["bitcoin", "ethereum", "crypto", "blockchain", "defi", "nft", "stablecoin", "binance", "coinbase", "sec etf"],
    "🤖 AI": ["artificial intelligence", "ai", "openai", "chatgpt", "gpt", "gemini", "anthropic", "nvidia", "llm", "machine learning"],
    "📊 Macro": ["gdp", "recession", "unemployment", "earnings report", "ipo", "merger", "acquisition", "tariff", "trade war", "default", "bankruptcy"],
    "🛢 Energy": ["oil price", "opec", "crude", "natural gas", "lng", "pipeline", "energy crisis"],
    "🎵 Entertainment": ["music", "album", "grammy", "oscar", "emmy", "film", "movie", "celebrity", "spotify", "artist", "tour"],
    "🏆 Sports": ["championship", "nfl", "nba", "world cup", "super bowl", "playoff", "premier league", "olympics", "ufc"],
    "🏥 Health/Medical": ["fda approval", "fda recall", "recall", "class i", "class ii", "vaccine", "pandemic", "drug trial", "clinical", "who", "outbreak", "public health"],
    "🌍 Climate": ["climate", "emissions", "carbon", "cop", "renewable", "net zero", "wildfire", "flood", "drought"],
    "🛡 Cybersecurity": ["cisa", "known exploited vulnerability", "kev catalog", "cve", "vulnerability", "exploit", "cyberattack", "data breach", "ransomware"],
    "🌪 Severe Weather": ["tornado warning", "hurricane warning", "severe thunderstorm warning", "flash flood warning", "earthquake", "emergency alert"],
}
#: Tags whose words occur in the synthetic tables.
BENCH_GEO = {"north": ["der", "und"], "south": ["que", "los"], "west": ["the", "license"]}
BENCH_TOPICS = {"rude": ["worthless", "pathetic", "idiot"], "common": ["of the", "and"], "law": ["license", "public"], "rare": ["with that"]}

# Headlines that are not news, in the regular expressions of Java and RE2 alike, lower-cased text.
LOW_SIGNAL = (
    r"\binterview with\b", r"\bi spent\b", r"\bmy week\b", r"\bmy day\b", r"\bopinion:", r"\beditorial:", r"\bcolumn:", r"\bcommentary:",
    r"\banalysis:", r"\bperspective:", r"\bthis week in\b", r"\bweekly (?:wrap|recap|roundup|digest)\b", r"\b(?:morning|evening) brief(?:ing)?\b",
    r"\b(?:daily|weekly) (?:roundup|recap|digest|brief)\b", r"\brecap:", r"\bexplained:", r"\bexplainer:", r"\bhow to\b", r"\bpodcast\b",
    r"\bvideo:", r"\bwatch:", r"\blive(?:stream)?:", r"\b\d+ (?:things|ways|reasons|tips|takeaways)\b",
)
# What is taken out of a prompt, in this order.
INJECTIONS = (
    r"(?i)\b(system|assistant|user)\s*:", r"(?i)ignore\s+(?:all\s+)?(?:prior|previous|above)\s+(?:instructions|rules|prompts|directions)",
    r"(?i)\[INST\]|\[/INST\]", r"<\|[^|]{1,40}\|>", r"(?i)\bact\s+as\b", r"(?i)\bnew\s+(?:instructions|rules|task)\b",
)
# Phrases that no output may hold.
BANNED = (
    r"sec\s+(?:just\s+)?(?:opened|launched|filed)\s+(?:a\s+)?(?:criminal\s+)?(?:probe|investigation)", r"\bcriminal\s+probe\b",
    r"\bi\s+am\s+(?:an?\s+)?ai\b", r"\bas\s+an?\s+ai\s+(?:language\s+)?model\b",
)
# Publishers that market-driven news may come from, in lower case.
PUBLISHERS = _words("""reuters, bloomberg, associated press, the associated press, ap news, afp, the new york times, nytimes, nytimes.com,
    new york times, nyt, the washington post, washingtonpost.com, washington post, the wall street journal, wsj, wsj.com,
    wall street journal, financial times, ft, ft.com, usa today, cnn, cnn.com, bbc, bbc news, bbc.com, nbc news, cbs news, abc news,
    fox news, fox business, msnbc, npr, pbs, pbs newshour, politico, axios, the hill, the atlantic, the new yorker, foreign affairs,
    foreign policy, the economist, economist.com, propublica, semafor, the guardian, guardian.com, al jazeera, aljazeera,
    aljazeera.com, dw, deutsche welle, reuters india, the japan times, the times of india, cnbc, cnbc.com, marketwatch, yahoo finance,
    yahoo!finance, business insider, businessinsider.com, barron's, barrons, barrons.com, investor's business daily,
    investors business daily, morningstar, espn, espn.com, the athletic, sports illustrated, bleacher report, cbs sports, nbc sports,
    fox sports, variety, the hollywood reporter, deadline, coindesk, cointelegraph, the block, decrypt, techcrunch, the verge, wired,
    wired.com, ars technica, engadget""")
# Filing items that matter, tracking parameters, title prefixes, allowed severities, classes and kinds.
FILING_ITEMS = _words("1.01, 1.02, 1.03, 2.01, 2.04, 2.05, 2.06, 3.01, 3.02, 4.01, 4.02, 5.01, 5.02, 5.03, 5.07, 8.01")
TRACKING = _words("utm_, fbclid, gclid, mc_, ref, ref_, igshid, s_cid, share")
TITLE_PREFIXES = _words("breaking, just in, exclusive, update, live, developing, alert, watch")
SEVERITIES, CLASSES, KINDS = ("Extreme", "Severe"), ("Class I", "Class II"), ("drug", "device", "food")
# Labels for display.
MODE_BADGES = {"pure_news": "⚡ Breaking", "news_odds": "📊 News + Odds", "engagement": "💬 Engagement"}
CATEGORY_LABELS = {"politics": "🗳 Politics", "economics": "📈 Economics", "crypto": "₿ Crypto", "sports": "🏆 Sports", "tech": "💻 Tech", "culture": "🎭 Culture", "cyber": "🛡 Cyber", "health": "🏥 Health", "weather": "🌪 Weather"}
TAG_LABELS = {
    "🇺🇸 美国": "🇺🇸 United States", "🇨🇳 中国": "🇨🇳 China", "🇷🇺 俄罗斯": "🇷🇺 Russia", "🇺🇦 乌克兰": "🇺🇦 Ukraine", "🇮🇷 伊朗": "🇮🇷 Iran", "🇮🇱 以色列": "🇮🇱 Israel",
    "🇪🇺 欧盟": "🇪🇺 European Union", "🇬🇧 英国": "🇬🇧 United Kingdom", "🌏 中东": "🌏 Middle East", "🇩🇪 德国": "🇩🇪 Germany", "🇯🇵 日本": "🇯🇵 Japan", "🇰🇷 韩国": "🇰🇷 South Korea",
    "🗳 选举": "🗳 Elections", "💰 利率/央行": "💰 Rates/Central Banks", "💥 军事/冲突": "💥 Military/Conflict", "⚖️ 制裁/法律": "⚖️ Sanctions/Legal", "🪙 加密": "🪙 Crypto",
    "📊 宏观经济": "📊 Macro", "🛢 能源": "🛢 Energy", "🎵 娱乐": "🎵 Entertainment", "🏆 体育": "🏆 Sports", "🏥 健康/医疗": "🏥 Health/Medical", "🌍 气候": "🌍 Climate",
    "🛡 Cybersecurity": "🛡 Cybersecurity", "🌪 Severe Weather": "🌪 Severe Weather",
}
