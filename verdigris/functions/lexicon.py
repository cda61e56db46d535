"""Word lists and codes that results depend on."""

# Phrases that claim without proof, by kind, in order.
SUPERLATIVES = ["선도적", "최고 수준", "세계 최고", "업계 최고", "최고의", "최상의", "독보적", "타의 추종을 불허", "압도적", "초격차", "탁월한"]
INTENSIFIERS = ["혁신적", "획기적", "대대적", "전면적", "적극적", "전폭적", "최첨단", "미래지향적", "차세대"]
ENVIRONMENTAL = ["친환경", "친환경적", "지속가능한", "녹색", "청정", "에코", "그린", "자연친화적", "환경친화적"]
COMMITMENTS = ["최선을 다", "노력하고 있", "지속적으로 개선", "앞장서고 있", "선도해 나가", "힘쓰고 있"]
ABSOLUTES = ["탄소중립", "탄소배출 걱정 없", "무공해", "무해", "100% 친환경", "100% 생분해", "완전 분해", "완전분해", "자연으로 돌아가"]
CONDITIONS = ["생분해", "퇴비화 가능", "재활용 가능", "자연분해", "썩는"]
ABSTRACTIONS = ["지구를 위한", "자연을 위한", "착한", "안심"]
VAGUE = SUPERLATIVES + INTENSIFIERS + ENVIRONMENTAL + COMMITMENTS + ABSOLUTES + CONDITIONS + ABSTRACTIONS
CATEGORIES = {"absolute": ABSOLUTES, "condition": CONDITIONS, "abstract": ABSTRACTIONS, "vague": SUPERLATIVES + INTENSIFIERS + ENVIRONMENTAL + COMMITMENTS}

# Strong phrases that a cited source must have too, and words that make "100 %" one.
OVERCLAIMS = ABSOLUTES + SUPERLATIVES + ["업계 유일", "업계 1위", "세계 1위", "국내 유일", "국내 1위", "유일한", "완전한"]
PERFECT = ENVIRONMENTAL + ["천연", "재활용", "완전", "유일", "무공해", "생분해", "자연분해"]

# Words beside a number that say what it measures, and its code; the first wins a tie.
TOPICS = [
    ("재생에너지", "renewable", "E-4-2"), ("온실가스", "ghg", "E-3-1"), ("탄소", "ghg", "E-3-1"), ("Scope", "ghg", "E-3-1"), ("배출", "ghg", "E-3-1"),
    ("폐기물", "waste", "E-6-1"), ("재활용", "waste_recycle", "E-6-2"), ("용수", "water", "E-5-1"), ("여성 이사", "board_female", "G-1-4"),
    ("이사회 성별", "board_female", "G-1-4"), ("여성", "female", "S-3-1"), ("정규직", "regular", "S-2-2"), ("이직률", "turnover", "S-2-3"),
    ("재해율", "safety", "S-4-2"), ("사외이사", "outside_director", "G-1-2"), ("출석률", "attendance", "G-2-1"), ("에너지", "energy", "E-4-1"),
]

# Words for falling and for rising.
FALLS, RISES = ["감소", "하락", "절감"], ["증가", "상승", "개선"]
