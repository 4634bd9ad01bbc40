"""Schemas of the logical tables. Every table is keyed by the question; a "view" of a document or an answer is a filter on one of them."""

from pyspark.sql import types as T

QUESTIONS = T.StructType([T.StructField("qid", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("answer_pattern", T.StringType())])
CLUES = T.StructType([T.StructField("qid", T.StringType()), T.StructField("clue_type", T.StringType()), T.StructField("label", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("reliable", T.BooleanType())])
LATS = T.StructType([T.StructField("qid", T.StringType()), T.StructField("lat_type", T.StringType()), T.StructField("base_lat_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("synset", T.LongType()), T.StructField("specificity", T.DoubleType())])
TRIPLES = T.StructType([T.StructField("s", T.StringType()), T.StructField("p", T.StringType()), T.StructField("o", T.StringType()), T.StructField("o_is_uri", T.BooleanType()), T.StructField("lang", T.StringType())])
SNIPPET = T.StructType([T.StructField("kind", T.StringType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("property", T.StringType()), T.StructField("witness", T.StringType())])

# Kinds of clues, in the order of their subtypes.
CLUE_TYPES = ("Token", "Phrase", "SV", "NE", "LAT", "Subject", "SubjectNE", "SubjectToken", "SubjectPhrase", "Ngram", "Concept")
# The names of the answer features, in their order.
FEATURES = """
    occurences resultRR resultLogScore passageLogScore propertyScore propertyGloVeScore originPsg originPsgFirst originPsgByClueToken
    originPsgByCluePhrase originPsgByClueSV originPsgByClueNE originPsgByClueLAT originPsgByClueSubject originPsgByClueSubjectNE
    originPsgByClueSubjectToken originPsgByClueSubjectPhrase originPsgByClueNgram originPsgByClueConcept originPsgByAbstractClue
    originPsgByConceptSourceRR originPsgByConceptLabelRR originPsgByConceptScore originPsgNP originPsgNE originPsgNPByLATSubj originPsgBIO
    originPsgSurprise originDocTitle originBingSnippet originDBpOntology originDBpONoClue originDBpOClueToken originDBpOCluePhrase originDBpOClueSV
    originDBpOClueNE originDBpOClueLAT originDBpOClueSubject originDBpOClueSubjectNE originDBpOClueSubjectToken originDBpOClueSubjectPhrase
    originDBpOClueNgram originDBpOClueConcept originDBpOConceptSourceRR originDBpOConceptLabelRR originDBpOConceptScore originDBpProperty
    originDBpPNoClue originDBpPClueToken originDBpPCluePhrase originDBpPClueSV originDBpPClueNE originDBpPClueLAT originDBpPClueSubject
    originDBpPClueSubjectNE originDBpPClueSubjectToken originDBpPClueSubjectPhrase originDBpPClueNgram originDBpPClueConcept
    originDBpPConceptSourceRR originDBpPConceptLabelRR originDBpPConceptScore originFreebaseOntology originFreebaseSpecific originFreebaseBranched
    originFreebaseWitnessMid originFreebaseWitnessLabel originFBONoClue originFBOClueToken originFBOCluePhrase originFBOClueSV originFBOClueNE
    originFBOClueLAT originFBOClueSubject originFBOClueSubjectNE originFBOClueSubjectToken originFBOClueSubjectPhrase originFBOClueNgram
    originFBOClueConcept originFBOConceptSourceRR originFBOConceptLabelRR originFBOConceptScore originConcept originConceptBySubject
    originConceptByLAT originConceptByNE originConceptSourceRR originConceptLabelRR originConceptScore originMultiple psgDistClueToken
    psgDistCluePhrase psgDistClueSV psgDistClueNE psgDistClueLAT psgDistClueSubject psgDistClueSubjectNE psgDistClueSubjectToken
    psgDistClueSubjectPhrase psgDistClueNgram psgDistClueConcept psgDistConceptSourceRR psgDistConceptLabelRR psgDistConceptScore bioScore noTyCor
    LATANone spWordNet LATQNoWordNet LATANoWordNet tyCorPassageSp tyCorPassageDist tyCorPassageInside simpleScore answerFocusNone answerFocusWhole
    LATNE LATDBpType LATDBpWNType LATQuantity LATQuantityCD LATWnInstance LATDBpOntology LATDBpProperty LATFBOntology tyCorSpQHit tyCorSpAHit
    tyCorSpNoHit tyCorSpQAHit tyCorSpMultiHit tyCorANE tyCorADBp tyCorADBpWN tyCorAQuantity tyCorAQuantityCD tyCorAWnInstance tyCorADBpOntology
    tyCorADBpProperty tyCorAFBOntology clOCMatchScore clOCPrefixedScore clOCPrefixingScore clOCSuffixedScore clOCSuffixingScore clOCSubstredScore
    clOCSubstringScore clOCMetaMatchScore clOMatchScore clOPrefixedScore clOPrefixingScore clOSuffixedScore clOSuffixingScore clOSubstredScore
    clOSubstringScore clOMetaMatchScore evdPrefixedScore evdPrefixingScore evdSuffixedScore evdSuffixingScore evdSubstredScore evdSubstringScore
    topAnswer solrHitsEv solrAHitsEv solrHitsANormEv solrMaxScoreEv solrHitsMaxScoreEv phase0Score phase1Score questionClassABBR questionClassDESC
    questionClassENTY questionClassHUM questionClassLOC questionClassNUM
""".split()
