"""The labelled table of the personal-data field: lines of text, each span marked as ``[kind|value]``."""

LINES = (
    # Secrets in settings, scripts, logs and prose.
    'api_key = "[secret|sk9fQ2mLx81Tz0vYw7RbN4cHd6KeJpUa]"',
    "export ACCESS_TOKEN=[secret|7d1f0c93be52a64488e0d7c1f3ab9264e5c07f18]",
    'token = "[secret|3fa85f6457174562b3fc2c963f66afa6e91b0d27]" # rotate in spring',
    'password: "[secret|Vt7qLm2Xz9Rk4Wd8]"',
    "the key was [secret|e3b0c44298fc1c149afbf4c8996fb92427ae41e4] until last week",
    "Authorization: Bearer [secret|eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9a8Qz]",
    "secret=[secret|9a4f2e71c6d80b35f17a6e2c4d9b8053] and nothing else",
    "curl -H 'X-Auth: [secret|0b7e6a54d2c91f8833aa5be0417cd629]' then wait",
    'client_secret: "[secret|Gx4Tn8Ls2Qv6Pz0Ym3Rw7Kc1Jb5Hd9Fe]",',
    "we found ([secret|5f4dcc3b5aa765d61d8327deb882cf99]) in the old file",
    "login used [secret|mN8bV5cX2zL0kJ7hG4fD1sA9] , which is gone now",
    'db.token="[secret|c0ffee1234567890abcdef0987654321deadbeef]";',
    'private key id "[secret|8843d7f92416211de9ebb963ff4ce28125932878]" was revoked',
    "please set key: [secret|Zk3Yx9Wv5Ut1Sr7Qp2On8Ml4] before the start",
    "token [secret|2fd4e1c67a2d28fced849ee1bb76e7391b93eb12]",
    "and then [secret|da39a3ee5e6b4b0d3255bfef95601890afd80709]. So it went",
    'old value "[secret|77de68daecd823babbb58edb1c8e14d7106e83bb]"!!',
    'old value "[secret|A94A8FE5CCB19BA61C4C0873D391E987982FBBD3]"!! AND NEW',
    'TOKEN = "[secret|B1D5781111D84F7B3FE45A0852E59758CD7A87E5]" IS OUT',
    'their token = "[secret|902ba3cda1883801594b6e1b452790cc53948fda]"### said so',
    'a token = "[secret|fe5dbbcea5ce7e2988b8c69bcfdfde8904aabc1f]"*** was lost',
    'the token = "[secret|0ade7c2cf97f75d009975f4d720d1fa6c19f4897]"%%% again',
    'le mot de passe = "[secret|b3f0c7f6bb763af1be91d9e74eabfeb199dc1f1f]" est ancien',
    'la clave = "[secret|4d134bc072212ace2df385dae143139da74ec0ef]", dijo',
    'das Kennwort = "[secret|f1abd670358e036c31296e66b3b66c382ac00812]" gilt nicht',
    "webhook [secret|hT5rW8yQ3eU6iO1pA4sD7fG0] may post",
    "AKIA style ids like [secret|AKQ4ZX7MN2RT9VB5WL3C] give access",
    "use [secret|ghx_7Yt5Rf3Ed1Ws9Qa8Zx6Cv4Bn2Mk0Lp] to pull",
    "PASSWORD=[secret|Tr0ub4dor3xKcd9QwZ]",
    "session [secret|6f1ed002ab5595859014ebf0951522d9] was shared",
    "passphrase = '[secret|hunter2Zebra9Quartz4Lamp]'",
    '"secret": "[secret|p5sW9nJ3xC7vB1mZ8kL2]"}',
    # Mail addresses, with and without a full domain.
    "write to [email|ana.lopez@example.com] today",
    "mail [email|j.smith42@mail3.example.org], please",
    "([email|office@example.net]) answers soon",
    "From: [email|root@localhost] at night",
    "ask [email|kim_lee@intranet] for the form",
    "cc [email|press+news@example.co.uk]; thanks",
    "contact: [email|team.07@dept.example.edu].",
    "her new address [email|maria99@example.com] works",
    "sent by [email|build@ci-runner] this morning",
    # Telephone numbers in several notations.
    "call [phone|+1 (555) 012-3456] now",
    "phone [phone|(555) 867-5309] after six",
    "ring [phone|+44 20 7946 0958] or come by",
    "fax: [phone|(212) 555-0147], mornings",
    "mobile [phone|+49 151 23456789] was off",
    "tel. [phone|555-867-5309] is best",
    "numéro [phone|+33 1 23 45 67 89] le soir",
    "reach me at [phone|(415) 555-2671].",
    "dial [phone|+34912345678] para más",
    "office [phone|650-555-0199] until noon",
    "and the +1 office [phone|(303) 555-0188] too",
    "texted [phone|+1-202-555-0173] twice",
    # Cards and addresses of machines.
    "card [card|4111 1111 1111 1111] expired",
    "paid with [card|5500005555555559] online",
    "number [card|3400-0000-0000-0009] refused",
    "on [card|4012888888881881], again",
    "visa [card|4222 2222 2222 2222] was new",
    "host [ip|192.168.10.25] is up",
    "from [ip|10.0.0.7] to [ip|172.16.254.1] by night",
    "ping [ip|203.0.113.99], slow",
    "server [ip|8.8.4.4] answered",
    # Words with digits that are none of these.
    "on 12.05.2021 the 3 of them met",
    "in 1998 some 4500 people lived there",
    "version 2.14.3 fixed 17 bugs",
    "it cost $1,299.99 or about 40% less",
    "at 10:45 on 2024-01-31 it began",
    "room 101, floor 3, seat 24B",
    "see section 4.2.1 and table 7",
    "order 20231105 has 12 items",
    "a 4x4 and a B747 on route 66",
    "1. First point 2. Second point 3. Third",
    "the year 2020, the 21st century",
    "pages 120-135 of volume 9",
    "isbn 978-3-16-148410-0 is a book",
    "id 550e8400-e29b-41d4-a716-446655440000 names a row",
    "https://example.com/a/b?page=2 has more",
    "commit messages of 72 characters",
    "file_name_2023_final_v2.txt was kept",
    "covid19 and h1n1 in 3 towns",
    "@ the corner, 5 pm",
    "follow @user123 or not",
    "x = 42; y = 3.14159; z = x + y",
    "the key = 17 and the token = 5 in the game",
    "temperature: 21.5 degrees, 80% wet",
    "ratio 16:9 and 1024x768 pixels",
    "part-number AB-1234-CD fits",
    "zip 90210 and 10115",
    "run 00012345 of 99999999",
    "mp3 and mp4 and utf8 files",
    "score 3-1 after 90 minutes",
    "chapter 12: twenty-one-gun-salute",
    "well-known-and-much-loved-stories-of-2019",
    "items 001, 002, and 003",
    "0595 and 07687 came next",
    "the 9 lives of 1 cat (5)",
    "10% off!! 20% off### 30% off",
    "about 1200000 in all",
    "donaudampfschifffahrtsgesellschaft1830 was a name",
    "line 4521: value 88123345 seen",
    "serial 12345678901234567890 of the box",
    "1234567 5552368 are counts of rows",
)
