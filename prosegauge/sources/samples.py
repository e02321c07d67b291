"""Sample posts of our own, some thirty over the kinds of writing that the features tell apart; the id's prefix says what a reader would call them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (post_id, kind, text, links)
SAMPLES: list[tuple[str, str, str, int]] = [
    ("red-hook-list", "hook, emoji list, call to act", "Nobody talks about this.\n\nHere's the thing about success:\n\n🚀 Work hard\n🔥 Stay humble\n💡 Never quit\n✨ Help others\n\nAgree? Drop a comment below 👇", 0),
    ("red-anecdote", "anecdote with a moral", "My taxi driver taught me more than my MBA.\n\nHe smiled.\n\nI asked him why.\n\nHe said: it's not about the money. It's about the people.\n\nRead that again.\n\nThis changed everything for me.", 0),
    ("red-cta", "pure call to act", "Comment YES below and I'll send you the guide.\n\nLike this post. Follow me for more. Repost to help your network. ♻️\n\nWho's in?", 0),
    ("red-connectives", "connectives of a language model", "In today's fast-paced world, it's important to note that leadership is a journey. Let's delve into the tapestry of growth — a testament to resilience — and unlock the full potential of your team. Moreover, it's crucial to foster a culture of innovation.", 0),
    ("red-beats", "three-beat fragments", "No plan. No funding. No network. Just grit. Just heart. Just work. That's it. That's the post.", 0),
    ("red-credentials", "credentials and arrows", "I've hired 500+ people over 10 years.\n\nHere's what I learned:\n\n→ Attitude beats skill\n→ Culture beats strategy\n→ People beat process\n\nSave this post. Tag someone who needs it.", 0),
    ("red-shouting", "shouting", "STOP doing this NOW!!\nYOU ARE LOSING MONEY\nEVERY SINGLE DAY!!!\nNEVER accept less than you deserve", 0),
    ("red-vague", "vague numbers", "Here is the brutal truth, and it is a wake up call. Most people fail because they give up. Many leaders never listen. Some of the best companies in the world know this, and countless studies show that everyone can win big.", 0),
    ("red-humblebrag", "humblebrag", "I'm humbled and honored to share that I was named a top voice.\n\nFive years ago I was broke.\n\nToday I lead a team of amazing people.\n\nNever give up on your dreams.\n\n#blessed #leadership #mindset #grateful #success", 0),
    ("red-platitudes", "platitudes", "Success is not final. Failure is not fatal. Hard work always pays off. Be kind. Be bold. Be you.\n\nThoughts? 👇", 0),
    ("red-corporate", "corporate filler", "This is a game changer and a paradigm shift: the future of work. We leverage synergy to move the needle and drive value for our stakeholders. Our game-changing thought leadership empowers best-in-class teams to think outside the box at the end of the day.", 0),
    ("red-imperatives", "advice in imperatives", "You need to wake up early. You must read every day. You should stop making excuses. Don't wait. Start now. Invest in yourself. You have to want it.", 0),
    ("red-hashtags", "a pointer and many tags", "Stop scrolling.\n\nIt's not luck. It's discipline.\n\n👉 Link in the comments 👇👇\n\n#grind #hustle #mindset #success", 0),
    ("yellow-template", "useful but from a template", "3 things I check before every deploy:\n\n1. The migration runs backwards too\n2. The dashboard shows the error rate\n3. Someone else knows how to roll back\n\nWhat would you add?", 0),
    ("yellow-opinion", "general opinion", "I think good managers listen more than they talk. It is not easy and I am still learning it myself, but the teams that I have enjoyed working with all had someone who asked first and answered later.", 0),
    ("yellow-personal", "personal, without data", "Last spring I left a job that I had loved for a long time. I was afraid of the quiet, and then the quiet turned out to be what I had been missing. I still do not know what comes next.", 0),
    ("yellow-announcement", "announcement with a link", "We are happy to announce that our new office opens on Monday. Come by, say hello and have a coffee with the team. Details below.", 1),
    ("yellow-share", "a link and little else", "Worth a read this weekend, even if you do not agree with all of it.", 1),
    ("yellow-question", "a real question", "Does anyone here run background jobs on a managed queue without paying for idle workers? We have a few long tasks a day and everything I find is made for many short ones.", 0),
    ("yellow-emoji", "emoji and content", "Moved the build to a smaller machine 🛠️ and it got faster: 11 minutes instead of 14, because the cache now fits on the local disk. Odd, but we take it 🙂", 0),
    ("yellow-unpunctuated", "no punctuation", "so we tried the other database for a week and it was fine until the backups started to overlap with the night jobs and then it was not fine at all", 0),
    ("green-incident", "incident with numbers", "On Tuesday our Postgres 14 cluster at Northwind lost 3 of 9 replicas for 42 minutes. We traced it to a 2.5x jump in WAL volume after the 1.8 release, moved 12 tables to a new tablespace and cut the lag from 310 s to 6 s. The write-up with graphs and queries is linked below.", 1),
    ("green-technical", "technical prose", "The HTTP client in Kestrel 2.1 keeps 64 TLS sessions per host. If the API behind it answers in under 5 ms, the handshake takes 38% of the CPU time, so the pool in front of Redis should hold at least 256 of them.", 0),
    ("green-survey", "survey with a link", "The Marston survey of 1,204 nurses in Leeds found that 61% had worked an unpaid hour in the past week, against 48% in 2019. Dr Patel of the University of York, who ran it, says the change comes from wards with fewer than 20 beds.", 2),
    ("green-observation", "short observation", "The bakery on Hill Street sells 40 loaves by eight in the morning and 6 between noon and closing.", 0),
    ("green-argument", "argument with two sides", "Rent control in Vienna is often cited as a success, and 60% of its tenants do live in subsidised flats. But the waiting list at Wiener Wohnen has 12,000 names, and Stockholm, with stricter rules, has 730,000 on its own. The supply side, more than the cap, explains the gap between the two.", 0),
    ("green-abtest", "result of a test", "We ran the new checkout for 14 days on 21,400 sessions. Conversion rose from 2.31% to 2.38%, p = 0.27, so we are not shipping it. The one clear effect was on Safari 17, where errors fell by 44%.", 0),
    ("green-correction", "correction", "Correction to my post of 3 May: the figure for Lisbon is 18.4 million, not 14.8. I had read the column for Porto. Thanks to Ana Sousa at INE for pointing it out.", 1),
    ("green-resource", "shared resource", "Tufte's chapter on small multiples is 22 pages and covers most of what a dashboard of 9 charts needs. Chapter 3 of Wilkinson's Grammar of Graphics gives the theory. Both are in the library of the University of Utah.", 1),
    ("green-astral", "signs beyond the basic plane", "The glyphs 𝒜 and 𝔄 of Unicode 3.1 take 4 bytes in UTF-8 and 2 units in UTF-16, so a field of 40 units holds 20 of 𝕏𝕐ℤ. JDK 17 counts 40.", 0),
    ("short-fact", "very short", "Rust 1.80 is out.", 0),
]


def posts(spark: SparkSession) -> DataFrame:
    """post_id, kind, label, text, links of all samples."""
    rows = [(i, kind, i.split("-")[0], text, [f"https://example.org/{i}/{k}" for k in range(n)]) for i, kind, text, n in SAMPLES]
    return spark.createDataFrame(rows, "post_id string, kind string, label string, text string, links array<string>")
