"""The default labelled table of URLs, small enough for the driver; a table of one's own is a parameter of the filter.

Terms are written out by hand, none after a given table; hosts and paths are made
of them by forms that both labels share, so that only the terms tell them apart.
Wanted terms hold words that merely contain an unwanted one.
"""

from __future__ import annotations

#: Gambling, sex, medicines without prescription, stolen software, quick money, click traffic.
UNWANTED = """
gambling poker roulette blackjack sportsbook slotmachine slots jackpot wager baccarat bingo lottery bookmaker betting onlinebet livebet scratchcard
porn xxx sex sexy nude naked escort camgirl livecam hentai milf erotic fetish hotgirls hookup xvideo pornhub onlyfans stripper sexchat
viagra cialis tramadol xanax levitra pharmacy noprescription dietpill weightloss steroids hgh kamagra cheapmeds rxstore
warez crack keygen serialkey nulled torrent cracked freedownload activator patchfull modapk piratebay fullversion
payday payloan quickcash getrich forexsignal bitcoindoubler moneyback makemoney earncash cryptogiveaway instantloan ponzi
freeporn pornstar sexvideo xtube adultery lesbian bdsm swinger voyeur playboy bookie oddsmaker keno craps holdem megaslots winbig freespins sweepstake
painkiller oxycodone ambien valium modafinil botox slimming testosterone viagraonline cloner hacktool crackedapps fakeid fakepassport moneylaundry binaryoption penny-stock mlm pyramid
popunder clickbait adserver adclick bannerad doorway linkfarm backlinks seolinks trafficbot pixeltag affiliate replica fakewatch knockoff
""".split()

WANTED = """
library museum university school garden recipes weather history science journal travel music health council theatre hospital archive
trackandfield racetrack soundtrack tracking alphabet betterment tibet elizabeth diabetes essex sussex middlesex sextant sexton unisex adulthood
specialist socialism socialist pillar pillow caterpillar pokerface potpourri analysis canal cockpit hancock scunthorpe grapes therapist
classic assembly compass embassy passenger shuttlecock dickens moby cockatoo address download downloads documents gradient roadside shadows
headline deadline toad broadband loan student mortgage bank insurance invest economy market trade finance accounting taxes pension payroll
football tennis hockey cricket sports athletics olympics chess cycling swimming climbing sailing marathon stadium league fitness yoga
medicine clinic nursing dental surgery vaccine cancer nutrition therapy pediatrics pharmacology chemistry biology physics geology astronomy
software python java linux database compiler opensource developer kernel network security cloud hosting server browser mobile
river mountain forest ocean island harbor bridge railway airport station village castle cathedral abbey church temple mosque
bakery kitchen coffee teahouse brewery winery cheese bread chocolate vegan farming orchard honey fishery butcher
news press daily times herald gazette tribune chronicle observer radio television magazine editor blog podcast video film cinema camera
painting sculpture poetry novel author bookshop literature grammar dictionary translate language linguistics philosophy ethics religion
government parliament senate justice court law legal police embassy passport election democracy census statistics policy
family children parents wedding baby toys games puzzle lego craft knitting sewing quilting pottery woodwork furniture
hotel hostel camping cruise flight tickets map guide tourism weekend holiday beach skiing safari adventure
github gitlab wikipedia wikimedia stackoverflow reuters guardian bbc nature springer elsevier arxiv mozilla apache debian ubuntu docker kubernetes
openstreetmap project institute foundation society association committee agency bureau office ministry department laboratory workshop studio gallery
mapping shopping market store shop bookstore grocery pizza pasta sushi salad dinner breakfast lunch farmland vineyard greenhouse flower plants tree animals wildlife birds horse kitten puppy
dentist doctor nurse patient optics acoustic ceramic textile fashion shoes jacket jewelry perfume beauty hair salon barber spa massage wellness running walking hiking
energy solar wind battery electric engine motor vehicle bicycle truck tractor aviation rocket satellite robot
""".split()

#: Forms of hosts and of paths; {0} is a term, {1} a number.
HOSTS = ("http://www.{0}.com/", "https://{0}{1}.net/index.html", "http://best{0}.co.uk/page/{1}", "https://my-{0}-online.info/", "http://{0}world.example/a/{1}?id=2", "https://the{0}.io/about", "http://{0}s.org/", "https://top{0}s{1}.biz/go", "http://{0}.{0}club.us/x?y=1")
PATHS = ("http://www.site{1}.com/{0}/", "https://host{1}.net/blog/{0}-{1}.html", "http://forum.example/topic/free-{0}/{1}", "https://cdn{1}.com/en/{0}s?ref={1}")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for unwanted): each term in three forms of hosts and two of paths."""
    terms = [(t, 1) for t in UNWANTED] + [(t, 0) for t in WANTED]
    n, m = len(HOSTS), len(PATHS)
    return [(form.format(t, 7 * i % 97), y) for i, (t, y) in enumerate(terms) for form in (*[HOSTS[(i + k * (1 + i // n % 2)) % n] for k in range(3)], PATHS[i % m], PATHS[(i + 1) % m])]
