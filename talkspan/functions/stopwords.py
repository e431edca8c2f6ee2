"""Default English function words. Any other list can be passed to the cleaning functions."""

DEFAULT_STOP_WORDS = tuple(
    """
    a about above across after again against all almost alone along already also although always am
    among an and another any anything are around as at
    back be became because become been before behind being below between both but by
    can cannot could
    did do does done down during
    each either else enough even ever every everyone everything except
    few first for from further
    get give go
    had has have he hence her here hers herself him himself his how however
    i if in indeed into is it its itself
    just keep last least less
    made many may me might mine more most much must my myself
    neither never next no nobody none nor not nothing now
    of off often on once one only onto or other others our ours out over own
    per perhaps please quite rather really
    same say see seem several she should show since so some someone something still such
    take than that the their them then there these they this those through to too toward
    under until up upon us
    very via was we well were what when where which while who whole whose why will with within would
    yet you your yours
    """.split()
)
