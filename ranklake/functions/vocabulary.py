"""The words by which conditions are recognised in queries and texts, and the weights of scores."""

from __future__ import annotations

COLOR_TERMS = {
    "white": ("흰", "하얀", "백색", "화이트", "white"),
    "black": ("검", "검정", "까만", "블랙", "black"),
    "brown": ("갈색", "브라운", "brown"),
    "tan": ("황색", "황갈", "탄", "tan"),
    "cream": ("크림", "아이보리", "cream", "ivory"),
    "gray": ("회색", "그레이", "gray", "grey"),
    "spotted": ("무늬", "얼룩", "반점", "spotted"),
}
SIZE_TERMS = {
    "tiny": ("초소형", "아주 작", "미니", "tiny"),
    "small": ("소형", "작은", "작고", "작은개", "small"),
    "medium": ("중형", "중간", "medium"),
    "large": ("대형", "큰", "크고", "large"),
}
FUR_TERMS = {
    "short": ("단모", "짧은 털", "털이 짧", "short"),
    "medium": ("중간 털", "중간 길이", "medium"),
    "long": ("장모", "긴 털", "털이 긴", "long"),
    "curly": ("곱슬", "푸들", "curly"),
    "fluffy": ("복슬", "복슬복슬", "풍성", "fluffy"),
}
EAR_TERMS = {
    "upright": ("귀가 선", "귀가 서", "쫑긋", "upright"),
    "floppy": ("처진 귀", "귀가 처", "floppy"),
    "semi_upright": ("반쯤 선", "반립", "semi"),
    "folded": ("접힌 귀", "folded"),
}
SEX_TERMS = {"M": ("수컷", "남아", "남자", "male"), "F": ("암컷", "여아", "여자", "female")}
AGE_TERMS = {
    "puppy": ("어린 강아지", "새끼", "어린 개", "생후", "개월", "puppy"),
    "adult": ("성견", "adult"),
    "senior": ("노령", "노견", "고령", "senior"),
}
PERSONALITY_TERMS = ("순함", "차분", "조용", "활발", "애교", "사람 좋아", "겁", "소심", "경계", "공격")
STOPWORDS = ("강아지", "유기견", "추천", "찾아줘", "원해", "좋아", "가능", "사진", "조건")
FACETS = {
    "coat_color": COLOR_TERMS,
    "fur_length": FUR_TERMS,
    "ear_shape": EAR_TERMS,
    "body_size_hint": SIZE_TERMS,
    "sex": SEX_TERMS,
    "age_hint": AGE_TERMS,
}
FACET_LABELS = {
    "coat_color": "털색",
    "fur_length": "털길이",
    "ear_shape": "귀모양",
    "body_size_hint": "몸집",
    "sex": "성별",
    "age_hint": "나이",
    "personality": "성향",
}
#: A label counts only outside the words of the more specific one.
BROADER = {"coat_color": ("tan", "brown"), "body_size_hint": ("tiny", "small")}

HARD_CLOSED_TOKENS = ("종료", "반환", "자연사", "안락사", "기증")
ADOPTION_OPEN_TOKENS = ("입양대기", "입양가능", "입양문의")
ACTIVE_TOKENS = ("보호중", "공고중", "보호")

BM25_K1, BM25_B = 1.5, 0.75
MODALITY_WEIGHTS = {"text": 0.45, "full_image": 0.25, "crop_image": 0.20}
FUSION_WEIGHTS = {"vector": 0.44, "bm25": 0.18, "conditions": 0.20, "visual": 0.06, "prior": 0.12}
RRF_K = 60
RBO_DEPTH, RBO_PERSISTENCE = 10, 0.9
COMPATIBILITY_WEIGHT, QUALITY_WEIGHT = 0.25, 0.05
FEATURE_WEIGHTS = {"region": 1.15, "shelter": 1.15, "status": 1.15, "notice": 1.15, "trait": 1.0, "sex": 1.0, "age": 1.0,
                   "photo": 1.0, "temperament": 0.65, "neuter": 0.45, "breed": 0.35}
OTHER_FEATURE_WEIGHT = 0.75
GRAPH_WEIGHTS = {"place": 0.32, "features": 0.18, "none": 0.05}
